"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

Each line of a file, and the whole of it, is compared with every template, and the runs of lines from each line on that are about
as long as a template with that one. Only words of the templates can add to a product; how common they are is counted over
all files. A bound on the cosine, by running sums over all words, parts most passages from all templates at once. A file
without a licence of its own inherits from the nearest directory above it that holds a licence file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodepath.llm.session import bounded_batches, stored
from lodepath.llm.words import split_words

#: Licences with texts that grant them: the words that headers and notices use, short licences in full, and the
#: opening lines of the long ones.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007. Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991. Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
]
#: Directories that hold over one in so many files are dealt to several tasks.
HEAVY = 10_000
LICENCE_FILE = re.compile(r"(?i)^(un)?(licen[cs]e|copying|notice)([-._].*)?$")


class Templates:
    """Templates as unit TF-IDF rows over their own words. n_files and df come from all files."""

    def __init__(self, templates: list[tuple[str, str]], n_files: int = 0, df: dict[str, int] | None = None) -> None:
        self.names = [n for n, _ in templates]
        words, at = split_words(pa.array([t for _, t in templates], pa.string()))
        self.vocab = words.unique()
        ids = pc.index_in(words, value_set=self.vocab).to_numpy()
        idf = lambda n: np.log((n_files + 1) / (n + 1)) + 1
        self.idf = np.array([idf((df or {}).get(w, 0)) for w in self.vocab.to_pylist()] or [1.0])
        self.rare = float(idf(0))  # a word of no template counts as a rare one
        tf = np.zeros((len(templates), len(self.vocab)))
        for i, (s, e) in enumerate(zip(at, at[1:])):
            np.add.at(tf[i], ids[s:e], 1.0)
        tf *= self.idf
        self.rows = tf / np.linalg.norm(tf, axis=1, keepdims=True)
        self.lengths = np.diff(at)

    def word_ids(self, words: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, value_set=self.vocab), -1).to_numpy().astype(np.int64)

    def cosines(self, words: pa.Array, ids: np.ndarray) -> np.ndarray:
        """Of one passage with every template."""
        known = ids >= 0
        tf = np.bincount(ids[known], minlength=len(self.idf)) * self.idf
        times = pc.value_counts(words.filter(pa.array(~known))).field("counts").to_numpy()
        norm = np.sqrt(tf @ tf + ((times * self.rare) ** 2).sum())
        return np.minimum(self.rows @ tf / norm, 1.0)

    def passages(self, ids: np.ndarray, at: np.ndarray, files: np.ndarray, least: float) -> np.ndarray:
        """Passages that may reach the cosine: rows of (first line, past the last, template). at has the words before each line, files
        the lines before each file. Tried are each line, each whole file, and from each line on the runs that end just before
        and just after the template's length. A passage's length is at least the root of its words' squared weights (repeats of
        a word only add to it), so the product over that root bounds the cosine: no passage is lost."""
        lines = np.flatnonzero(np.diff(at) > 0)
        last = files[np.searchsorted(files, lines, "right")]
        weight = np.where(ids >= 0, self.idf[ids], self.rare)
        square = np.concatenate([[0.0], np.cumsum(weight**2)])
        whole = np.stack([files[:-1], files[1:]], axis=1)
        found = []
        for k, (row, length) in enumerate(zip(self.rows, self.lengths)):
            part = np.concatenate([[0.0], np.cumsum(np.where(ids >= 0, weight * row[ids], 0.0))])
            over = np.minimum(np.searchsorted(at, at[lines] + length), last)
            tried = [np.stack([lines, end], axis=1) for end in (lines + 1, over, over - 1)]
            tried = np.concatenate([*tried, whole])
            s, e = at[tried[:, 0]], at[tried[:, 1]]
            may = (e > s) & (part[e] - part[s] >= (least - 1e-9) * np.sqrt(np.maximum(square[e] - square[s], 0)))
            found.append(np.insert(tried[may], 2, k, axis=1))
        return np.unique(np.concatenate(found), axis=0)


def document_frequencies(files: DataFrame, templates: list[tuple[str, str]]) -> tuple[int, dict[str, int]]:
    """Number of files, and of those that hold each word of the templates. One small row for each batch and word."""
    bounded_batches(files.sparkSession)
    plain = Templates(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(plain.vocab), np.int64), 0
        for b in batches:
            words, at = split_words(b.column(0))
            ids = plain.word_ids(words)
            row = np.repeat(np.arange(b.num_rows), np.diff(at))[ids >= 0]
            total += np.bincount(np.unique(row * len(total) + ids[ids >= 0]) % len(total), minlength=len(total))
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*plain.vocab.to_pylist(), None]), pa.array([*total.tolist(), n])], names=["word", "n"])

    rows = files.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word: r.n for r in rows}
    return found.pop(None, 0), found


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.8, piece: int = 256) -> DataFrame:
    """(file_id, path, text) -> file_id, path, own_license, similarity, is_licence_file, licence, inherited_from.

    own_license is the template most alike to any passage, if the cosine is at least `least`; of templates equally alike the first
    listed. A licence file is named like one, or is, as a whole, such a passage. Nearest-ancestor inheritance: files without
    an own licence take that of the closest directory above that has licence files; of several there, the most alike, then
    the smaller path, counts.

    Null texts are empty and null paths have no directories. Very long texts are read whole. Empty tables give no rows; repeated
    rows are repeated. Other columns are not read. piece: files of a directory that meet its licence in one
    task, or one in HEAVY of all if that is more.
    """
    spark = files.sparkSession
    n, df = document_frequencies(files, templates)
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(Templates(templates, n, df))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            parts = pc.split_pattern(pc.fill_null(b.column(2), ""), "\n")
            files_at = np.asarray(parts.offsets) - parts.offsets[0].as_py()
            words, at = split_words(parts.flatten())
            ids = t.word_ids(words)
            tried = t.passages(ids, at, files_at, least)
            hits: dict[int, tuple[float, int]] = {}
            whole = set()
            cos, of = None, None
            for s, e, top in tried.tolist():
                if of != (s, e):
                    cos, of = t.cosines(words.slice(at[s], at[e] - at[s]), ids[at[s] : at[e]]), (s, e)
                if cos[top] < least:
                    continue
                k = int(np.searchsorted(files_at, s, "right")) - 1
                hits[k] = max(hits.get(k, (0.0, 0)), (float(cos[top]), -top))
                if at[s] == at[files_at[k]] and at[e] == at[files_at[k + 1]]:
                    whole.add(k)
            name = [t.names[-hits[k][1]] if k in hits else None for k in range(b.num_rows)]
            sim = [hits[k][0] if k in hits else None for k in range(b.num_rows)]
            named = [bool(LICENCE_FILE.match((p or "").rpartition("/")[2])) for p in b.column(1).to_pylist()]
            is_file = [k in whole or (x and k in hits) for k, x in enumerate(named)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(name, pa.string()), pa.array(sim, pa.float64()), pa.array(is_file, pa.bool_())], names=["file_id", "path", "own_license", "similarity", "is_licence_file"])

    plain = files.select(F.col("file_id").cast("long").alias("file_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    own = stored(plain.mapInArrow(run, "file_id long, path string, own_license string, similarity double, is_licence_file boolean"), "licences")

    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    first = Window.partitionBy("dir").orderBy(F.desc("similarity"), "path", "file_id")
    given = own.where("is_licence_file").select(folder.alias("dir"), "similarity", "path", "file_id", F.col("own_license").alias("licence"))
    given = stored(given.withColumn("r", F.row_number().over(first)).where("r = 1").select("dir", "licence"), "given")
    # the directories of files without a licence, each once, meet their ancestors; then files meet their directory. Directories of
    # over one in HEAVY of these files, at most so many, are dealt to several keys
    bare = own.where("own_license IS NULL AND path IS NOT NULL").withColumn("at", folder)
    needy = stored(bare.groupBy("at").agg(F.count("*").alias("n")), "directories")
    share = F.greatest(F.lit(piece), F.ceil(F.lit(needy.agg(F.sum("n")).first()[0] or 0) / F.lit(HEAVY)))
    heavy = F.broadcast(needy.where(F.col("n") > share).select("at", F.ceil(F.col("n") / share).alias("salts")))
    steps = F.split("at", "/", -1)
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    climbed = needy.select("at", F.explode(F.array_distinct(above)).alias("dir")).join(given, "dir")
    nearest = climbed.groupBy("at").agg(F.max_by(F.struct("dir", "licence"), F.length("dir")).alias("n")).join(heavy, "at", "left")
    salts = F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1).cast("long")) - 1)
    nearest = nearest.select("at", F.explode(salts).alias("salt"), "n.dir", F.col("n.licence").alias("got"))
    dealt = bare.join(heavy, "at", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("file_id", "path"), F.col("salts")), F.lit(0).cast("long")))
    found = dealt.join(nearest, ["at", "salt"], "left")
    rest = own.where("own_license IS NOT NULL OR path IS NULL").withColumn("dir", F.lit(None).cast("string")).withColumn("got", F.lit(None).cast("string"))
    columns = ["file_id", "path", "own_license", "similarity", "is_licence_file"]
    out = found.select(*columns, "dir", "got").unionByName(rest.select(*columns, "dir", "got"))
    return out.select(*columns, F.coalesce("own_license", "got").alias("licence"), F.col("dir").alias("inherited_from"))
