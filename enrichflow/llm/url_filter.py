"""Block or allow URLs by host and path rules, and by a classifier where no rule fits.

The classifier is a logistic regression on hashed character n-grams (3 to 5 bytes) of host and path. It learns from a small
labelled URL table, at most ``PER_CLASS`` distinct URLs of each class in hash order.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?``, ``#`` or the end.
Both are empty without ``://`` and for null. A rule fits its host and all subdomains if the path starts with the rule's; the
one with the longest host and path wins, then the longer host, then block. Without labelled URLs of both classes the
classifier gives the class that there is, or allow. Rows stay as they come; repeated rows and rows without ``page_id`` are
judged alike and other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from enrichflow.llm.learning import sigmoid
from enrichflow.llm.words import _BYTES, _range_hashes, mix

PER_CLASS, DIMENSIONS, SIZES = 2000, 1 << 16, (3, 4, 5)
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: str = "url") -> tuple[Column, Column]:
    """Host and path of a URL column."""
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, _CAPITALS, _SMALL), path


def rule_of(rules: Sequence[Rule], host: str = "host", path: str = "path") -> Column:
    """Struct of ``rule`` and ``verdict`` of the rule that wins, null if none fits."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.verdict == "block")):
        fits = ((F.col(host) == rule.host) | F.endswith(F.col(host), F.lit(f".{rule.host}"))) & F.startswith(F.col(path), F.lit(rule.path))
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def gram_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the n-grams of each text, and where each text's start."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    parts = []
    for size in SIZES:
        at = np.flatnonzero(np.arange(len(data)) + size <= ends[owner]) if len(data) else np.zeros(0, np.int64)
        ids = mix(_range_hashes(data, at, at + size, _BYTES) + np.uint64(size)) & np.uint64(DIMENSIONS - 1)
        parts.append((owner[at], ids.astype(np.int64)))
    rows, ids = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(rows, kind="stable")
    return ids[order], np.searchsorted(rows[order], np.arange(len(texts) + 1))


def _totals(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(values))
    return (sums[first[1:]] - sums[first[:-1]]) / np.sqrt(np.maximum(np.diff(first), 1))


@dataclass
class Model:
    weights: np.ndarray
    constant: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        ids, first = gram_features(texts)
        return sigmoid(_totals(self.weights[ids], first) + self.constant)


def _text(host: str, path: str) -> bytes:
    return f"^{host}{path}$".encode()


def fit(urls: DataFrame, per_class: int = PER_CLASS, steps: int = 150, rate: float = 0.1, penalty: float = 1e-4) -> Model:
    """A model from a labelled table of ``url`` and ``label`` (1 is to be blocked)."""
    host, path = split_url()
    known = urls.filter("url IS NOT NULL AND label IN (0, 1)").select(host.alias("host"), path.alias("path"), F.col("label").cast("int").alias("label")).distinct()
    rows = [r for c in (0, 1) for r in known.filter(F.col("label") == c).orderBy(F.xxhash64("host", "path"), "host", "path").limit(per_class).collect()]
    target = np.array([r.label for r in rows], float)
    if not len(rows) or target.all() or not target.any():
        return Model(np.zeros(DIMENSIONS), 20.0 if len(rows) and target.all() else -20.0)
    ids, first = gram_features([_text(r.host, r.path) for r in rows])
    owner = np.repeat(np.arange(len(rows)), np.diff(first))
    share = 1 / np.sqrt(np.maximum(np.diff(first), 1))
    theta, one, two = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    weight = np.where(target == 1, 0.5 / target.mean(), 0.5 / (1 - target.mean())) / len(rows)
    for step in range(1, steps + 1):
        error = weight * (sigmoid(_totals(theta[ids], first) + theta[-1]) - target)
        gradient = np.append(np.bincount(ids, (error * share)[owner], DIMENSIONS), error.sum()) + penalty * theta
        one, two = 0.9 * one + 0.1 * gradient, 0.99 * two + 0.01 * gradient**2
        theta -= rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
    return Model(theta[:-1], float(theta[-1]))


def judged(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Per row: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, and ``score`` where the classifier decided.

    Without a labelled table, the URLs that rules decide are one.
    """
    host, path = split_url()
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("hit", rule_of(rules))
    if labelled is None:
        labelled = parts.filter("hit IS NOT NULL").select("url", (F.col("hit.verdict") == "block").cast("int").alias("label"))
    model = fit(labelled)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_text(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            score = pa.array(model.scores(texts), mask=np.array(batch.column("rule").is_valid()))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, "score"])

    out = parts.select("page_id", "host", "path", "hit.rule", F.col("hit.verdict").alias("ruled")).mapInArrow(
        rows, f"page_id {dict(pages.dtypes)['page_id']}, host string, path string, rule string, ruled string, score double")
    told = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", told).alias("verdict"), "score")
