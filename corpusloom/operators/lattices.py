"""Graphs of translations: best paths, rest scores, posteriors of edges, confidences of words.

Edges are rows (graph, prev, next, score, words): from state to state, score being a logarithm of a probability or any
log-linear score; a graph begins in state 0 and ends in the states without edges onwards. A graph is that of one segment, so its edges are gathered
in one row, and each task works through its graphs; graphs are dealt over tasks. States may have any numbers. Edges that lie on no way from the
first state to an end, on cycles among others, have no part in anything.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST = 0


class Lattice:
    """One graph's edges in the order of their states, without those that lead nowhere."""

    def __init__(self, edges: list[dict]):
        onwards, waiting = defaultdict(list), defaultdict(int)
        seen, todo = {FIRST}, [FIRST]
        for e in edges:
            onwards[e["prev"]].append(e)
        while todo:  # what can be reached
            for e in onwards[todo.pop()]:
                waiting[e["next"]] += 1
                if e["next"] not in seen:
                    seen.add(e["next"])
                    todo.append(e["next"])
        self.states, todo = [], [FIRST] * (not waiting[FIRST])
        while todo:  # before a state, all that leads to it
            state = todo.pop()
            self.states.append(state)
            for e in onwards[state]:
                waiting[e["next"]] -= 1
                if not waiting[e["next"]]:
                    todo.append(e["next"])
        known = set(self.states)
        self.ends = {s for s in self.states if not onwards[s]}
        self.edges = [e for s in self.states for e in onwards[s] if e["next"] in known]
        self.rest = self.backward(max)
        self.edges = [e for e in self.edges if self.rest[e["next"]] > -np.inf]

    def backward(self, add: Callable) -> dict[int, float]:
        """Of each state, the scores of the ways to an end, put together."""
        out = {s: 0.0 if s in self.ends else -np.inf for s in self.states}
        for e in reversed(self.edges):
            out[e["prev"]] = add(out[e["prev"]], e["score"] + out[e["next"]])
        return out

    def best(self) -> tuple[list[str], float, list[int]]:
        """Words, score and states of the best path; of equals, at each state the edge to the lesser state, then with lesser words."""
        at, words, states = FIRST, [], [FIRST]
        onwards = defaultdict(list)
        for e in self.edges:
            onwards[e["prev"]].append(e)
        while onwards[at]:
            e = min(onwards[at], key=lambda e: (-round(e["score"] + self.rest[e["next"]], 9), e["next"], e["words"]))
            words += e["words"]
            at = e["next"]
            states.append(at)
        return words, self.rest.get(FIRST, -np.inf), states

    def posteriors(self) -> tuple[list[float], dict[str, float]]:
        """The share of all ways that goes through each edge; of each word the largest share that has it at one place."""
        rest = self.backward(np.logaddexp)
        total = rest.get(FIRST, -np.inf)
        # Ways to a state by the number of words on them.
        ways: dict[int, dict[int, float]] = defaultdict(dict)
        ways[FIRST][0] = 0.0
        shares, places = [], defaultdict(lambda: -np.inf)
        for e in self.edges:
            share = -np.inf
            for n, score in ways[e["prev"]].items():
                through = score + e["score"]
                ways[e["next"]][n + len(e["words"])] = np.logaddexp(ways[e["next"]].get(n + len(e["words"]), -np.inf), through)
                share = np.logaddexp(share, through)
                for i, w in enumerate(e["words"]):
                    places[w, n + i] = np.logaddexp(places[w, n + i], through + rest[e["next"]])
            shares.append(float(np.exp(share + rest[e["next"]] - total)))
        words: dict[str, float] = defaultdict(float)
        for (w, _), score in places.items():
            words[w] = max(words[w], min(1.0, float(np.exp(score - total))))
        return shares, words


def _of_graphs(edges: DataFrame, columns: str, make: Callable[[Lattice], list[tuple]]) -> DataFrame:
    kind = edges.schema["graph"].dataType.simpleString()
    words = F.coalesce(F.filter("words", lambda w: w.isNotNull()), F.array().cast("array<string>"))
    edge = F.struct(F.col("prev").cast("bigint").alias("prev"), F.col("next").cast("bigint").alias("next"), F.col("score").cast("double").alias("score"), words.alias("words"))
    packed = edges.where("prev is not null and next is not null and score is not null").groupBy("graph").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    schema = edges.sparkSession.createDataFrame([], f"graph {kind}, {columns}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            rows = [(graph, *r) for graph, x in zip(*[c.to_pylist() for c in batch.columns], strict=True) for r in make(Lattice(x))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return packed.mapInArrow(run, schema)


def best_paths(edges: DataFrame) -> DataFrame:
    """(graph, words, score, states): the best path of each graph; graphs without any way to an end have none."""
    return _of_graphs(edges, "words array<string>, score double, states array<bigint>", lambda g: [g.best()] if g.edges else [])


def rest_scores(edges: DataFrame) -> DataFrame:
    """(graph, state, score): the best score from each state to an end."""
    return _of_graphs(edges, "state bigint, score double", lambda g: [(s, r) for s, r in g.rest.items() if r > -np.inf])


def edge_posteriors(edges: DataFrame) -> DataFrame:
    """(graph, prev, next, words, posterior) of each edge on a way to an end: at any cut through a graph they add up to 1."""
    return _of_graphs(edges, "prev bigint, next bigint, words array<string>, posterior double", lambda g: [(e["prev"], e["next"], e["words"], p) for e, p in zip(g.edges, g.posteriors()[0], strict=True)])


def word_confidences(edges: DataFrame) -> DataFrame:
    """(graph, word, confidence): the largest share of all ways that has the word at one place, counted in words."""
    return _of_graphs(edges, "word string, confidence double", lambda g: list(g.posteriors()[1].items()))
