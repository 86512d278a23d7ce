"""The recurrent policy of the beam search: numpy forward passes over Arrow batches, as a scoring function of search.beam_search.

A path is replayed from its start, so no state is carried between rounds and any executor can score any item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodepath.functions.vectors import as_double, dot

#: Names of the parameters in a trained model's file; gates lie in the order input, forget, cell, output.
NAMES = {
    "wx": "lstm_layer.lstm.weight_ih_l0", "wh": "lstm_layer.lstm.weight_hh_l0", "bx": "lstm_layer.lstm.bias_ih_l0", "bh": "lstm_layer.lstm.bias_hh_l0",
    "a1": "actor_head.fc_1.weight", "c1": "actor_head.fc_1.bias", "a2": "actor_head.fc_2.weight", "c2": "actor_head.fc_2.bias",
    "v1": "critic_head.0.weight", "d1": "critic_head.0.bias", "v2": "critic_head.2.weight", "d2": "critic_head.2.bias",
}
STOP_RELATION, STOP_ENTITY = "stop", "stop stop action"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class Policy:
    """Weights by the short names of NAMES; rows of a matrix are outputs."""

    weights: dict[str, np.ndarray]

    @property
    def hidden(self) -> int:
        return self.weights["wh"].shape[1]

    def step(self, observed: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One observation for each row of a batch: the new hidden and cell states."""
        w = self.weights
        i, f, g, o = np.split(observed @ w["wx"].T + w["bx"] + h @ w["wh"].T + w["bh"], 4, axis=1)
        c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
        return _sigmoid(o) * np.tanh(c), c

    def wish(self, h: np.ndarray) -> np.ndarray:
        """The actor: the action vector that a state wishes for; an action's score is its dot product with it."""
        w = self.weights
        return np.maximum(h @ w["a1"].T + w["c1"], 0.0) @ w["a2"].T + w["c2"]

    def value(self, h: np.ndarray) -> np.ndarray:
        """The critic: the value of each state."""
        w = self.weights
        return (np.maximum(h @ w["v1"].T + w["d1"], 0.0) @ w["v2"].T + w["d2"])[:, 0]

    def replay(self, question: np.ndarray, nodes: list[np.ndarray]) -> np.ndarray:
        """The last hidden state of each row: question (n, d); nodes: for each row its path's vectors (steps, d)."""
        h = np.zeros((len(nodes), self.hidden))
        c = np.zeros_like(h)
        steps = np.array([len(p) for p in nodes])
        for t in range(steps.max(initial=0)):
            on = np.flatnonzero(steps > t)
            seen = np.concatenate([question[on], np.stack([nodes[k][t] for k in on])], axis=1)
            h[on], c[on] = self.step(seen, h[on], c[on])
        return h


def seeded(seed: int, inputs: int = 600, hidden: int = 1024, mlp: int = 2048, outputs: int = 600) -> Policy:
    """A policy with random weights of a usual scale: none that is trained is public."""
    r = np.random.default_rng(seed)
    shapes = {
        "wx": (4 * hidden, inputs, hidden), "wh": (4 * hidden, hidden, hidden), "bx": (4 * hidden, hidden), "bh": (4 * hidden, hidden),
        "a1": (mlp, hidden, hidden), "c1": (mlp, hidden), "a2": (outputs, mlp, mlp), "c2": (outputs, mlp),
        "v1": (mlp, hidden, hidden), "d1": (mlp, hidden), "v2": (1, mlp, mlp), "d2": (1, mlp),
    }
    return Policy({n: r.uniform(-1, 1, s[:-1]) / np.sqrt(s[-1]) for n, s in shapes.items()})


def loaded(path: str) -> Policy:
    """A policy from an .npz file of the parameters by their long names."""
    with np.load(path) as file:
        return Policy({n: file[long].astype(float) for n, long in NAMES.items()})


def with_state(items: DataFrame, policy: Policy) -> DataFrame:
    """items (any keys, question: vector, walked: array of vectors) -> the keys, wish: vector, value. The weights are broadcast:
    their size is the model's own, whatever the data."""
    keys = [c for c in items.columns if c not in ("question", "walked")]
    shared = items.sparkSession.sparkContext.broadcast(policy)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(*keys).schema) + ", wish array<double>, value double"

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            question = np.array(batch.column("question").to_pylist(), float)
            h = model.replay(question, [np.array(p, float) for p in batch.column("walked").to_pylist()])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(list(model.wish(h)), pa.list_(pa.float64())), pa.array(model.value(h))], names=[*keys, "wish", "value"])

    return items.mapInArrow(forward, schema)


def scorer(policy: Policy, questions: DataFrame, entities: DataFrame, relations: DataFrame):
    """A scoring function for beam_search. questions: (query_id, vec); entities and relations: (text, vec), each text once.

    An observation is the question's vector and the node's; an action is its relation's and its next node's, where the action that
    stays counts as STOP_RELATION and STOP_ENTITY. A relation without a sentence says "a can cause b". What has no vector is
    scored 0, which the search masks.
    """
    asked = questions.select("query_id", as_double(F.col("vec")).alias("question"))
    entity = entities.select(F.col("text").alias("e_"), as_double(F.col("vec")).alias("ev"))
    relation = relations.select(F.col("text").alias("r_"), as_double(F.col("vec")).alias("rv"))

    def score(acts: DataFrame) -> DataFrame:
        items = acts.select("query_id", "beam", "path").distinct()
        steps = items.select("query_id", "beam", F.posexplode("path").alias("i", "e_")).join(entity, "e_")
        walked = steps.groupBy("query_id", "beam").agg(F.array_sort(F.collect_list(F.struct("i", "ev"))).alias("s"))
        met = items.join(walked, ["query_id", "beam"]).where(F.size("s") == F.size("path")).join(asked, "query_id")
        state = with_state(met.select("query_id", "beam", "question", F.col("s.ev").alias("walked")), policy)
        said = F.when(F.col("action") == 0, F.lit(STOP_RELATION)).otherwise(F.coalesce(F.nullif("sentence", F.lit("")), F.concat("node", F.lit(" can cause "), "next")))
        to = F.when(F.col("action") == 0, F.lit(STOP_ENTITY)).otherwise(F.col("next"))
        rows = acts.withColumn("r_", said).withColumn("e_", to).join(entity, "e_", "left").join(relation, "r_", "left").join(state, ["query_id", "beam"], "left")
        return rows.withColumn("score", F.coalesce(dot(F.concat("rv", "ev"), F.col("wish")), F.lit(0.0))).drop("r_", "e_", "rv", "ev", "wish", "value")

    return score
