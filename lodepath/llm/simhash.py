"""SimHash near-dedup: fingerprints of word shingles, compared exactly in tiles.

Fingerprints are made in Python over Arrow batches (one pass over the text), everything later works on 64-bit values.
Distinct fingerprints are laid out in cells of equal population counts of their four 16-bit quarters; tiles are runs of
neighbouring cells, or hashed parts of a large cell. Two fingerprints within a radius differ by no more than it in
the sum of the differences of their quarters' counts, so most pairs of tiles, and of blocks within tiles, are skipped
without a comparison; what is left is compared with numpy's exclusive-or and bitwise_count. No pair is lost.

Where texts must be alike, a bound on SimHash bits would lose links, so what the tiles compare are odd sketches of the sets of
shingles: bit i says whether the shingles whose hash leaves i modulo the sketch's size are odd in number. Each shingle that only
one of two sets has turns one bit, so the sketches never differ in more bits than the sets do in shingles, and sets of
a similarity s differ in (1 - s) / (1 + s) of their sizes' sum at most: that is the radius of a pair, and no pair is lost.
Pairs within it are candidates; what they connect is a family, and all pairs of a family are decided exactly by
matrix products of its shingle sets, in cells of bounded size. No pair of a family is made into a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodepath.llm.components import components
from lodepath.llm.session import bounded_batches, discard, stored, trimmed

SEED = 42
QUARTERS = 4
#: Bits of an odd sketch, powers of two: as many as the set has shingles, within these. Beyond the greatest, sketches tell less apart
#: and more pairs are decided by their sets.
LEAST_BITS, MOST_BITS = 64, 1 << 16
#: A cell of a family holds so many texts and shingles.
CELL_TEXTS, CELL_SHINGLES = 1024, 400_000
BLOCK = 256
#: A to Z in lower case, in bytes of UTF-8; bytes.split() then parts words at exactly the six ASCII white spaces.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, words: int = 4, seed: int = SEED, chunk: int = 1 << 16) -> int:
    """Unsigned 64-bit SimHash of a whole text's shingles, repeats included; 0 if it has no words."""
    parts = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    width = min(words, len(parts))
    stops = ends[width - 1 :].tolist()
    starts = [0, *(ends[: len(parts) - width] + 1).tolist()]
    hash_of, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), chunk):
        h = np.array([hash_of(joined[s:e], seed) for s, e in zip(starts[at : at + chunk], stops[at : at + chunk])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((counts * 2 > len(starts)).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprints(docs: DataFrame, words: int = 4, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null and wordless texts have 0."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words, seed) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(trimmed(run), "doc_id long, fp long")


def roots_of(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n nodes over the links u-v."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def spanning(fps: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links u-v between fingerprints, a few that connect the same ones: each part takes its closest link to another part,
    again and again (Boruvka), so close pairs stay linked directly."""
    order = np.argsort(np.bitwise_count(fps[u] ^ fps[v]), kind="stable")
    u, v = u[order], v[order]
    label, kept = np.arange(len(fps)), []
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        ends, link = np.stack([a, b], axis=1).ravel(), np.repeat(np.arange(len(u)), 2)
        pick = np.unique(link[np.unique(ends, return_index=True)[1]])
        kept.append(np.stack([u[pick], v[pick]]))
        label = roots_of(len(fps), a[pick], b[pick])[label]
    return tuple(np.concatenate(kept, axis=1)) if kept else (np.empty(0, np.int64), np.empty(0, np.int64))


def quarters(fps: np.ndarray) -> np.ndarray:
    """Population counts of the 16-bit quarters, low first: a row for each fingerprint."""
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint16).reshape(-1, QUARTERS)).astype(np.int16)


def boxes(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest quarter counts of each block of BLOCK fingerprints."""
    q, at = quarters(fps), np.arange(0, len(fps), BLOCK)
    return np.minimum.reduceat(q, at), np.maximum.reduceat(q, at)


def gap(low_a, high_a, low_b, high_b) -> np.ndarray:
    """The least sum of differences of counts between any two members of two boxes; all pairs of boxes."""
    d = np.maximum(low_a[:, None] - high_b[None], low_b[None] - high_a[:, None])
    return np.maximum(d, 0).sum(axis=2)


def ordered(fps: np.ndarray) -> np.ndarray:
    q = quarters(fps)
    return fps[np.lexsort((q[:, 3], q[:, 2], q[:, 1], q[:, 0]))]


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int, hold: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links within the radius between tile a and tile b (None: within a).

    Links are reduced to these whenever hold more of them have gathered, so a tile full of near copies costs no more
    memory than another.
    """
    a = ordered(a)
    both = a if b is None else np.concatenate([a, ordered(b)])
    other, shift = (a, 0) if b is None else (both[len(a) :], len(a))
    todo = np.argwhere(gap(*boxes(a), *boxes(other)) <= radius)
    if b is None:
        todo = todo[todo[:, 0] <= todo[:, 1]]
    us, vs, held = [], [], 0

    def forest() -> tuple[np.ndarray, np.ndarray]:
        if not us:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        u, v = np.concatenate(us), np.concatenate(vs)
        u, v = u[u != v], v[u != v]
        x, y = spanning(both, u, v)
        pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
        return pair[0], pair[1]

    for i, j in todo.tolist():
        x, y = a[i * BLOCK : (i + 1) * BLOCK], other[j * BLOCK : (j + 1) * BLOCK]
        near = np.bitwise_count(x[:, None] ^ y[None]) <= radius
        if near.any():
            u, v = np.nonzero(near)
            us.append(u + i * BLOCK)
            vs.append(v + j * BLOCK + shift)
            held += len(u)
            if held > hold:
                u, v = forest()
                us, vs, held = [u], [v], 0
    u, v = forest()
    return both[u], both[v]


def tile_plan(cells: np.ndarray, counts: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For cells in order (rows of quarter counts) and their sizes: first tile of each cell, number of tiles it is dealt
    to (1 unless it is larger than a tile), and the cells' tile boxes are later taken from these."""
    first, parts = np.empty(len(cells), np.int64), np.ones(len(cells), np.int64)
    now, room = -1, 0
    for i, n in enumerate(counts.tolist()):
        if n > tile:
            parts[i] = -(-n // tile)
            first[i] = now + 1
            now, room = now + int(parts[i]), 0
        else:
            if n > room:
                now, room = now + 1, tile
            first[i] = now
            room -= n
    return first, parts, np.int64(now + 1)


def tiled(rows: DataFrame, spread: str, features, gap_of, tile: int, most_tiles: int, weight: Column | None = None) -> tuple[DataFrame, DataFrame] | None:
    """Pairs of tiles that may hold links: (x, y), two lists of structs of rows' columns; y is null where a tile meets itself.
    And the tiles, which are stored. None if there are no rows.

    rows have longs, binaries and a long `cell`; a tile holds rows up to a sum of weights (1 each). features(cells) are a cell's features, and gap_of(low, high, lows, highs) says which of some tiles'
    boxes of features a tile's box has to meet. Rows of a cell that is larger than a tile are dealt by the column spread.
    The driver sees the histogram of cells only, and the plan of tiles that follows from it. Tiles grow with the root of
    the rows, so that copies of tiles stay few, and with the rows where there would be more than most_tiles of them.
    """
    spark = rows.sparkSession
    size = F.ceil(F.sum(F.lit(1.0) if weight is None else weight)).cast("long")
    found = rows.groupBy("cell").agg(size.alias("size")).orderBy("cell").collect()
    if not found:
        return None
    cell, count = np.array([r[0] for r in found], np.int64), np.array([r["size"] for r in found], np.int64)
    n = int(count.sum())
    tile = max(tile, min(n // 256, 8 * tile), n // most_tiles)
    q = features(cell)
    first, parts, n_tiles = tile_plan(q, count, tile)
    low, high = np.full((n_tiles, q.shape[1]), 99), np.full((n_tiles, q.shape[1]), -1)
    for c, f, p in zip(q, first, parts):
        low[f : f + p] = np.minimum(low[f : f + p], c)
        high[f : f + p] = np.maximum(high[f : f + p], c)
    plan = spark.sparkContext.broadcast((cell, first, parts, low, high))
    bounded_batches(spark)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, first, parts, _, _ = plan.value
        for b in batches:
            at = np.searchsorted(cell, b.column("cell").to_numpy())
            part = (b.column(spread).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[at]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(first[at] + part)], names=[*b.schema.names[:-1], "tile"])

    columns = [c for c in rows.columns if c != "cell"]
    shape = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    dealt = rows.select(*columns, "cell").mapInArrow(trimmed(deal), f"{shape}, tile long")
    tiles = stored(dealt.groupBy("tile").agg(F.collect_list(F.struct(*columns)).alias("x")), "tiles")

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, _, low, high = plan.value
        for b in batches:
            for i, t in enumerate(b.column(0).to_pylist()):
                to = t + 1 + np.flatnonzero(gap_of(low[t], high[t], low[t + 1 :], high[t + 1 :]))
                for some in np.array_split(to, -(-len(to) // 16)) if len(to) else []:
                    yield pa.RecordBatch.from_arrays([pa.array(some), b.column(1).take(pa.array(np.full(len(some), i)))], names=["tile", "y"])

    each = tiles.schema["x"].dataType.simpleString()
    sent = tiles.mapInArrow(trimmed(partners), f"tile long, y {each}")
    return tiles.select("x", F.lit(None).cast(each).alias("y")).unionByName(sent.join(tiles, "tile").select("x", "y")), tiles


def linked(made: tuple[DataFrame, DataFrame], compare) -> DataFrame:
    """The links (u, v) that compare finds in pairs of tiles, stored; each pair is compared once, and then the tiles go."""
    pairs, tiles = made
    links = stored(pairs.mapInArrow(trimmed(compare), "u long, v long"), "tile_links")
    discard(tiles)
    return links


def members(list_: pa.ListScalar) -> dict[str, np.ndarray]:
    """The columns of a tile's list of structs."""
    return {f.name: list_.values.field(f.name).to_numpy(zero_copy_only=False) for f in list_.values.type}


def near_links(fps: DataFrame, radius: int = 4, tile: int = 8192, most_tiles: int = 50_000) -> DataFrame:
    """Distinct longs (fp) -> (u, v): links that span every component of the fingerprints within the radius.

    Cells are of equal population counts of the quarters, at most 17 to the power 4, 83,521, however large the corpus. Work is
    dealt by pairs of tiles.
    """
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(65535))).cast("long") for k in range(QUARTERS)]
    keyed = fps.select("fp", (quarter[0] * 4913 + quarter[1] * 289 + quarter[2] * 17 + quarter[3]).alias("cell"))
    features = lambda cell: np.stack([cell // 4913, cell // 289 % 17, cell // 17 % 17, cell % 17], axis=1)
    meets = lambda low, high, lows, highs: np.maximum(np.maximum(low - highs, lows - high), 0).sum(axis=1) <= radius
    pairs = tiled(keyed, "fp", features, meets, tile, most_tiles)
    if pairs is None:
        return stored(fps.sparkSession.createDataFrame([], "u long, v long"), "tile_links")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(*b.columns):
                u, v = tile_links(members(x)["fp"].view(np.uint64), members(y)["fp"].view(np.uint64) if y.is_valid else None, radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return linked(pairs, compare)


def shingled(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Of each text: the hashes of its different shingles, ascending; of the whole sequence if it has fewer words, none if it has
    none. Words are the contract's, A-Z in lower case; a shingle's hash is a polynomial in those of its words, then mixed."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(w, SEED) if w else 0 for w in coded.dictionary.to_pylist()], np.uint64)
    flat = own[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.uint64)
    at = np.asarray(lists.offsets)
    keep = flat != 0  # empty words stand between spaces; a word whose hash is zero is as rare as any one hash
    at = np.concatenate([[0], np.cumsum(keep)])[at - at[0]]
    flat = flat[keep]
    base = np.uint64(0x9E3779B97F4A7C15)

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def rolled(w: np.ndarray, width: int) -> np.ndarray:
        h = np.full(max(len(w) - width + 1, 0), width, np.uint64)
        for k in range(width):
            h = h * base + w[k : k + len(h)]
        return mixed(h)

    whole, found = rolled(flat, words), []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        h = whole[s : e - words + 1] if e - s >= words else rolled(flat[s:e], e - s) if e > s else flat[:0]
        found.append(np.unique(h))
    return found


def bits_of(n):
    """Bits of the odd sketch of n shingles."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)


def folded(words: np.ndarray) -> np.ndarray:
    """Odd sketches of half the size, from sketches as columns of words."""
    half = len(words) // 2
    return words[:half] ^ words[half:]


def sketch(shingles: np.ndarray) -> tuple[int, int, int, bytes]:
    """Of a set of shingles (ascending): its hash, its SimHash, its odd sketch folded to 64 bits, and whole."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = int((bits * 2 > len(shingles)).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))
    size = int(bits_of(len(shingles)))
    odd = np.packbits((np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little")
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED), fp, int(np.bitwise_xor.reduce(odd.view(np.uint64))), odd.tobytes()


SKETCH = ("c", "fp", "fold", "odd")


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, h, text) -> (doc_id, h, n, and SKETCH): n is the number of different shingles, c the hash of their set."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingled(b.column(2), words)
            made = [sketch(x) for x in sets]
            longs = np.array([m[:3] for m in made], np.uint64).reshape(-1, 3).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([len(x) for x in sets], pa.int64()), *map(pa.array, longs.T), pa.array([m[3] for m in made], pa.binary())], names=["doc_id", "h", "n", *SKETCH])

    return docs.select("doc_id", "h", "text").mapInArrow(trimmed(run), "doc_id long, h long, n long, c long, fp long, fold long, odd binary")


class Sketches:
    """A tile's classes by number of shingles, and their odd sketches at every size: at size L, a column of words for each class whose
    own sketch has L bits or more. These are the last ones, from `first` on."""

    def __init__(self, tile: dict[str, np.ndarray]) -> None:
        order = np.argsort(tile["n"], kind="stable")
        self.n, self.c = tile["n"][order], tile["c"][order]
        self.bits, odd = bits_of(self.n), tile["odd"][order]
        self.levels, words, size = {}, np.empty((0, 0), np.uint64), int(self.bits.max(initial=LEAST_BITS))
        while size >= LEAST_BITS:
            own = np.flatnonzero(self.bits == size)
            mine = np.frombuffer(b"".join(odd[own]), np.uint64).reshape(-1, size // 64).T
            words = np.concatenate([mine, folded(words)], axis=1) if words.size else np.ascontiguousarray(mine)
            self.levels[size] = (int(np.searchsorted(self.bits, size)), words)
            size //= 2

    def at(self, size: int, start: int, end: int) -> np.ndarray:
        first, words = self.levels[size]
        return words[:, start - first : end - first]


def candidates(a: dict[str, np.ndarray], b: dict[str, np.ndarray] | None, similar: float, rows: int = 32, columns: int = 4096, hold: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v), of class hashes, that connect what the pairs of tile a and tile b (None: within a) connect whose sizes and odd
    sketches allow the similarity. No more than `hold` pairs are held at once."""
    a = Sketches(a)
    other, shift = (a, 0) if b is None else (Sketches(b), len(a.c))
    names = a.c if b is None else np.concatenate([a.c, other.c])
    slack, share = 1 - 1e-9, (1 - similar) / (1 + similar) * (1 + 1e-9)
    lo = np.searchsorted(other.n, np.ceil(a.n * similar * slack))
    hi = np.searchsorted(other.n, np.floor(a.n / (similar * slack)), side="right")
    label, us, vs, held = np.arange(len(names)), [], [], 0
    for i in range(0, len(a.n), rows):
        end = min(i + rows, len(a.n))
        first, last = int(lo[i]) if b is not None else i, int(hi[end - 1])
        for j in range(first, last, columns):
            stop = min(j + columns, last)
            size = int(min(a.bits[i], other.bits[j]))
            x, y = a.at(size, i, end), other.at(size, j, stop)
            most = np.floor((a.n[i:end, None] + other.n[None, j:stop]) * share).astype(np.int32)
            differ, word = np.zeros(most.shape, np.int32), 0
            # unlike sketches differ in half of their bits, so most pairs are decided after these words
            while word < min(len(x), int(most[-1, -1]) // 28 + 2):
                differ += np.bitwise_count(x[word][:, None] ^ y[word][None])
                word += 1
            u, v = np.nonzero(differ <= most)
            fits = (v + j >= lo[u + i]) & (v + j < hi[u + i]) & ((v + j > u + i) if b is None else True)
            u, v = u[fits], v[fits]
            left, room = differ[u, v], most[u, v]
            while word < len(x) and len(u):
                left = left + np.bitwise_count(x[word][u] ^ y[word][v])
                near = left <= room
                u, v, left, room = u[near], v[near], left[near], room[near]
                word += 1
            if len(u):
                us.append(u + i)
                vs.append(v + j + shift)
                held += len(u)
                if held > hold:
                    label = roots_of(len(names), np.concatenate([*us, np.arange(len(names))]), np.concatenate([*vs, label]))
                    us, vs, held = [], [], 0
    label = roots_of(len(names), np.concatenate([*us, np.arange(len(names))]), np.concatenate([*vs, label]))
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def band_of(n, similar: float):
    """Sizes by a factor of 1 / similar: similar texts are in one band or in neighbours."""
    return F.floor(F.log(n.cast("double")) / F.lit(float(-np.log(min(similar, 0.95)) + 1e-9)))


def candidate_links(classes: DataFrame, similar: float, tile: int, most_tiles: int = 50_000) -> DataFrame:
    """classes (n and SKETCH) -> (u, v): links of class hashes that connect every family of candidates. Cells are of one band of
    sizes and one population count of the folded sketch; tiles of bands apart, or of counts further apart than the largest sets of
    their bands may differ, never meet."""
    cell = band_of(F.col("n"), similar) * 65 + F.bit_count("fold")
    rows = classes.select("n", "c", "odd", cell.cast("long").alias("cell"))
    features = lambda cell: np.stack([cell // 65, cell % 65], axis=1)
    width = -np.log(min(similar, 0.95)) + 1e-9

    def meets(low, high, lows, highs) -> np.ndarray:
        apart = np.maximum(np.maximum(low - highs, lows - high), 0)
        largest = np.exp((np.minimum(high[0], highs[:, 0]) + 1) * width)  # of the tile whose sets are smaller
        return (apart[:, 0] <= 1) & (apart[:, 1] <= (1 - similar) / (1 + similar) * largest * (1 + 1 / similar) + 1)

    pairs = tiled(rows, "c", features, meets, tile, most_tiles, 1 + F.octet_length("odd") / 256)
    if pairs is None:
        return stored(classes.sparkSession.createDataFrame([], "u long, v long"), "tile_links")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(*b.columns):
                u, v = candidates(members(x), members(y) if y.is_valid else None, similar)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return linked(pairs, compare)


def is_similar(both, x, y, similar: float):
    """Whether sets of x and y members, `both` of them in common, have that Jaccard similarity."""
    return (both >= similar * (x + y - both)) & (both > 0)


def alike(x: list[np.ndarray], y: list[np.ndarray], similar: float, wide: int = 4096) -> np.ndarray:
    """A matrix: which of the sets x are similar to which of the sets y."""
    size = [np.array([len(s) for s in z], np.int64) for z in (x, y)]
    flat = [np.concatenate(z) if z else np.empty(0, np.int64) for z in (x, y)]
    row = [np.repeat(np.arange(len(z)), n) for z, n in zip((x, y), size)]
    shared = np.intersect1d(*flat)
    if x is y:
        values, times = np.unique(flat[0], return_counts=True)
        shared = values[times > 1]
    at = [np.searchsorted(shared, f) for f in flat]
    known = [np.flatnonzero(shared[np.minimum(a, len(shared) - 1)] == f) if len(shared) else np.empty(0, np.int64) for a, f in zip(at, flat)]
    both = np.zeros((len(x), len(y)), np.float32)
    for low in range(0, len(shared), wide):
        parts = []
        for a, k, r, z in zip(at, known, row, (x, y)):
            k = k[(a[k] >= low) & (a[k] < low + wide)]
            part = np.zeros((len(z), min(wide, len(shared) - low)), np.float32)
            part[r[k], a[k] - low] = 1
            parts.append(part)
        both += parts[0] @ parts[1].T
    return is_similar(both.astype(np.int64), size[0][:, None], size[1][None], similar)


def family_links(texts: DataFrame, similar: float, words: int) -> DataFrame:
    """(key, c, n, text) -> links (u, v) of class hashes that span all pairs of a family (key) whose shingle sets are similar.

    A small family is one cell. A larger one is dealt to cells by band of size and to parts of bounded texts and shingles; each cell
    meets itself, those of its band and those of the next. A cell's links are reduced to a forest as they are found.
    """
    spark = texts.sparkSession
    bounded_batches(spark)
    size = lambda: F.ceil(F.greatest(F.sum("n") / CELL_SHINGLES, F.count("*") / CELL_TEXTS))
    big = texts.groupBy("key").agg(size().alias("parts")).where("parts > 1").select("key")
    sizes = stored(texts.select("key", "n").join(big, "key").groupBy("key", band_of(F.col("n"), similar).alias("band")).agg(size().alias("parts")), "family_sizes")
    placed = texts.withColumn("band", band_of(F.col("n"), similar)).join(sizes, ["key", "band"], "left")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("c"), F.col("parts"))).otherwise(F.lit(0))
    band = F.when(F.col("parts").isNotNull(), F.col("band")).otherwise(F.lit(-1))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [x.view(np.int64) for x in shingled(b.column(4), words)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(made, pa.list_(pa.int64()))], names=["key", "band", "part", "c", "shingles"])

    dealt = placed.select("key", band.alias("band"), part.alias("part"), "c", "text").mapInArrow(trimmed(sets), "key long, band long, part long, c long, shingles array<long>")
    cells = stored(dealt.groupBy("key", "band", "part").agg(F.collect_list(F.struct("c", "shingles")).alias("x")), "cells")
    each = sizes.select("key", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    units = each.join(each.toDF("key", "to_band", "to_part"), "key").where("to_band = band AND to_part > part OR to_band = band + 1")
    units = units.join(cells, ["key", "band", "part"]).join(cells.toDF("key", "to_band", "to_part", "y"), ["key", "to_band", "to_part"])
    alone = cells.where(F.size("x") > 1)
    units = alone.select("x", F.lit(None).cast(alone.schema["x"].dataType).alias("y")).unionByName(units.select("x", "y"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pair in zip(*b.columns):
                both = [z for z in pair if z.is_valid]
                names = [z.values.field("c").to_numpy() for z in both]
                held = [[s.values.to_numpy() for s in z.values.field("shingles")] for z in both]
                u, v = np.nonzero(alike(held[0], held[-1], similar))
                ends = np.concatenate(names)
                v = v + len(ends) - len(names[-1])
                label = roots_of(len(ends), u, v)
                moved = np.flatnonzero(label != np.arange(len(ends)))
                yield pa.RecordBatch.from_arrays([pa.array(ends[moved]), pa.array(ends[label[moved]])], names=["u", "v"])

    links = stored(units.mapInArrow(trimmed(judged), "u long, v long"), "family_links")
    discard(sizes, cells)
    return links


def similar_classes(plain: DataFrame, similar: float, words: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) -> each row's (doc_id, h, fp, c), and each class's (c, root, rep), both stored. A class is all texts of one
    set of shingles, known by a 64-bit hash; rep is its least document: no_id (ids before nulls), doc_id, h (the text's hash)."""
    rows = plain.withColumn("h", F.xxhash64("text"))
    made = stored(sketches(rows, words), "sketches")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("rep")
    classes = stored(made.groupBy("c").agg(rep, *[F.first(x).alias(x) for x in ("n", *SKETCH[1:])]), "classes")
    near = candidate_links(classes.where("n > 0"), similar, tile)
    families = components(near)
    asked = families.join(classes, F.col("node") == F.col("c")).select(F.col("root").alias("key"), "c", "n", "rep")
    same = rows.doc_id.eqNullSafe(asked.rep.doc_id) & (rows.h == asked.rep.h)
    texts = rows.join(asked, same).groupBy("key", "c", "n").agg(F.first("text").alias("text"))
    texts = stored(texts, "family_texts")
    links = family_links(texts, similar, words)
    names = components(links)
    known = classes.join(names, F.col("c") == F.col("node"), "left").select("c", F.coalesce("root", "c").alias("root"), "rep")
    known = stored(known, "roots")
    discard(classes, near, families, texts, links, names)
    return made, known


def least_documents(docs: DataFrame, similar: float = 0.8, shingle: int = 5, tile: int = 8192) -> DataFrame:
    """(no_id, doc_id, h): of each component of similar texts the document that stays, the one of the least id (documents without
    an id come last), then of the least text hash h = xxhash64(text). Linked are all texts whose sets of shingles have the
    Jaccard similarity; see near_components for the rest."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made, known = similar_classes(plain, similar, shingle, tile)
    left = stored(known.groupBy("root").agg(F.min("rep").alias("rep")).select("rep.*"), "least")
    discard(made, known)
    return left


def near_components(docs: DataFrame, words: int = 4, radius: int = 4, tile: int = 8192, seed: int = SEED, similar: float | None = None, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (doc_id, fp, component_id), the component's smallest doc_id.

    With `similar`, links are between texts whose sets of shingles of `shingle` words are that similar (Jaccard, exact; no link is
    lost), whatever the radius; fingerprints are of those sets. Texts of equal sets are one.

    Nulls: a null text has no words, so fingerprint 0, which links to others like any value (with `similar`: to other texts without
    words only); a null id is kept, and is a component's id only if all its ids are null. Repeated rows are repeated in the
    result; rows of one id and different texts are different documents. Very long texts are read whole. An empty table gives
    an empty result. Copies share a fingerprint and are compared once. Other columns are not read.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if similar is not None:
        made, known = similar_classes(plain, similar, shingle, tile)
        least = known.groupBy("root").agg(F.min("rep.doc_id").alias("component_id"))
        return made.join(known.join(least, "root").select("c", "component_id"), "c").select("doc_id", "fp", "component_id")
    made = stored(fingerprints(plain, words, seed), "fingerprints")
    distinct = made.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = near_links(distinct.select("fp"), radius, tile)
    names = components(links)
    discard(links)
    linked = distinct.join(names, distinct.fp == names.node).select("fp", "least", "root")
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    known = distinct.join(linked.select("fp", "root"), "fp", "left").join(roots, "root", "left")
    known = known.select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return made.join(known, "fp", "left").select("doc_id", "fp", "component_id")
