"""Embeddings as a table (model_id, text, vec): embedders, a store of what was embedded, and warming it before comparison."""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.request
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.leaf import cosine

STORE = "model_id string, text string, vec array<double>"


class Embedder:
    """model_id, dim and embed_many; embed_one follows."""

    model_id: str
    dim: int

    def embed_many(self, texts: Sequence[str]) -> list[np.ndarray]:
        raise NotImplementedError

    def embed_one(self, text: str) -> np.ndarray:
        return self.embed_many([text])[0]


class HashEmbedder(Embedder):
    """Unit vectors drawn from a generator that a text's BLAKE2b digest seeds: equal texts, equal vectors.

    Fixed values: 8 bytes of digest, read little-endian as the seed of NumPy's default generator; normal draws in single precision.
    """

    def __init__(self, dim: int = 32, model_id: str = "hash-mock"):
        if dim < 1:
            raise ValueError("dim must be positive")
        self.dim, self.model_id = dim, model_id

    def embed_many(self, texts: Sequence[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            x = np.random.default_rng(int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")).standard_normal(self.dim).astype(np.float32)
            out.append(x / (float(np.linalg.norm(x)) or 1.0))
        return out


class DictEmbedder(Embedder):
    """Vectors from a table; an unknown text is an error."""

    def __init__(self, vectors: dict[str, Sequence[float]], model_id: str = "dict-mock"):
        self.vectors, self.model_id = {k: np.asarray(v, dtype=float) for k, v in vectors.items()}, model_id
        self.dim = len(next(iter(self.vectors.values()), ()))

    def embed_many(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [self.vectors[t] for t in texts]


def post_json(url: str, payload: dict, key: str, timeout: float) -> dict:
    """One HTTP request with the standard library."""
    ask = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    with urllib.request.urlopen(ask, timeout=timeout) as answer:
        return json.load(answer)


class HttpEmbedder(Embedder):
    """An embeddings endpoint, asked in batches; ``client(url, payload, key)`` posts and returns the parsed answer.

    A request that fails is repeated up to ``max_retries`` times after 0.5, 1, 2, ... seconds; then its error is raised.
    """

    def __init__(self, model: str, base_url: str, client=None, api_key: str | None = None, dimensions: int | None = None, max_batch_size: int = 256, key_variable: str = "OPENAI_API_KEY", timeout: float = 60.0, max_retries: int = 2):
        if max_batch_size < 1 or max_retries < 0 or timeout <= 0:
            raise ValueError("max_batch_size and timeout must be positive, max_retries not negative")
        self.model, self.base_url, self.client, self.dimensions, self.most = model, base_url, client or partial(post_json, timeout=timeout), dimensions, max_batch_size
        self.retries = max_retries
        self.key = api_key or os.environ.get(key_variable) or "not-needed"
        host = base_url.split("//", 1)[-1].split("/", 1)[0]
        self.model_id, self.dim = f"{host}::{model}::d={dimensions}", dimensions or 0

    def _asked(self, payload: dict) -> dict:
        for k in range(self.retries + 1):
            try:
                return self.client(f"{self.base_url.rstrip('/')}/embeddings", payload, self.key)
            except OSError:  # URL errors and timeouts are of this kind
                if k == self.retries:
                    raise
                time.sleep(0.5 * 2**k)
        raise AssertionError

    def embed_many(self, texts: Sequence[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for lo in range(0, len(texts), self.most):
            payload = {"model": self.model, "input": list(texts[lo : lo + self.most])} | ({"dimensions": self.dimensions} if self.dimensions else {})
            rows = sorted(self._asked(payload)["data"], key=lambda r: r["index"])
            out += [np.asarray(r["embedding"], dtype=float) for r in rows]
        return out


def likeness_key(kind: Column, a: Column, b: Column) -> Column:
    return F.md5(F.concat_ws("\x1f", kind, a, b).cast("binary"))


class CosineMetric:
    """A comparator of strings by their embeddings, for schemas: custom_metrics={"string": {"by_meaning": CosineMetric(store)}}.

    Tables are scored with likenesses of distinct pairs of texts, joined; called on two texts, it asks the embedder.
    """

    def __init__(self, store: EmbeddingStore, mapping: str = "clip"):
        if mapping not in ("clip", "affine"):
            raise ValueError(f"mapping must be 'clip' or 'affine', not {mapping!r}")
        self.store, self.mapping, self.model_id, self.embedder = store, mapping, store.embedder.model_id, store.embedder

    def __getstate__(self) -> dict:
        return self.__dict__ | {"store": None}  # sessions stay on the driver

    def of(self, a: np.ndarray, b: np.ndarray) -> float:
        size = float(np.linalg.norm(a)) * float(np.linalg.norm(b))
        cos = float(np.dot(a, b)) / size if size > 0 else 0.0
        return max(0.0, min(1.0, cos if self.mapping == "clip" else (cos + 1) / 2))

    @property
    def kind(self) -> str:
        """What two texts' likeness depends on beside them."""
        return f"{self.model_id}\x1f{self.mapping}"

    def by_likeness(self, known: dict, gold: str, pred: str) -> float:
        """By the likenesses of a pair of documents, named by ``likeness_key``."""
        return known[hashlib.md5(f"{self.kind}\x1f{gold}\x1f{pred}".encode()).hexdigest()]

    def __call__(self, gold: str, pred: str) -> float:
        return self.of(*(np.asarray(v, dtype=float) for v in self.embedder.embed_many([gold, pred])))


def embed(texts: DataFrame, embedder: Embedder, column: str = "text") -> DataFrame:
    """STORE rows of the distinct texts of a column; nulls have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [str(t) for t in pdf["text"]]
            yield pd.DataFrame({"model_id": [embedder.model_id] * len(values), "text": values, "vec": [v.tolist() for v in embedder.embed_many(values)]})

    return texts.select(F.col(column).alias("text")).where("text IS NOT NULL").distinct().mapInPandas(run, STORE)


class EmbeddingStore:
    """A Parquet table of vectors by model; what is missing is embedded once and appended."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder):
        self.spark, self.path, self.embedder = spark, path, embedder

    def all(self) -> DataFrame:
        try:
            return self.spark.read.schema(STORE).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], STORE)

    def vectors(self) -> DataFrame:
        return self.all().where(F.col("model_id") == self.embedder.model_id)

    def missing(self, texts: DataFrame, column: str = "text") -> DataFrame:
        return texts.select(F.col(column).alias("text")).where("text IS NOT NULL").distinct().join(self.vectors().select("text"), "text", "left_anti")

    def warm(self, *columns: tuple[DataFrame, str]) -> int:
        """Embeds what the columns have and the store lacks, once; returns how many texts."""
        texts = None
        for df, column in columns:
            part = df.select(F.col(column).cast("string").alias("text"))
            texts = part if texts is None else texts.union(part)
        before = self.vectors().count()
        self._append(embed(self.missing(texts), self.embedder))
        return self.vectors().count() - before

    def _append(self, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("model_id").parquet(self.path)

    def contains(self, texts: DataFrame, column: str = "text") -> DataFrame:
        return texts.join(self.vectors().select(F.col("text").alias(column)), column, "left_semi")

    def get_many(self, texts: Sequence[str]) -> dict[str, np.ndarray]:
        """Vectors of some texts on the driver, embedded first where they are missing."""
        asked = self.spark.createDataFrame([(t,) for t in texts], "text string")
        self.warm((asked, "text"))
        return {r.text: np.asarray(r.vec) for r in self.vectors().join(F.broadcast(asked.distinct()), "text", "left_semi").collect()}

    def get_one(self, text: str) -> np.ndarray:
        return self.get_many([text])[text]

    def __contains__(self, text: str) -> bool:
        return self.vectors().where(F.col("text") == text).limit(1).count() > 0

    def __len__(self) -> int:
        return self.vectors().count()

    def clear(self) -> None:
        """Drops this model's vectors alone: its folder is deleted, no other is read or written."""
        jvm = self.spark._jvm
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(self.embedder.model_id)
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/model_id={name}")
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


class SessionStore(EmbeddingStore):
    """The same for one session: vectors are held by Spark, and gone with it."""

    def __init__(self, spark: SparkSession, embedder: Embedder):
        self.spark, self.embedder = spark, embedder
        self.held = spark.createDataFrame([], STORE)

    def all(self) -> DataFrame:
        return self.held

    def _append(self, rows: DataFrame) -> None:
        new = rows.persist()
        new.count()
        self.held = self.held.union(new)

    def clear(self) -> None:
        self.held = self.spark.createDataFrame([], STORE)


def similarity(pairs: DataFrame, vectors: DataFrame, a: str, b: str, mapping: str = "clip", out: str = "score") -> DataFrame:
    """Adds the cosine similarity of two text columns by their vectors (text, vec); without a vector it is null."""
    left = vectors.select(F.col("text").alias("_ta"), F.col("vec").alias("_va"))
    right = vectors.select(F.col("text").alias("_tb"), F.col("vec").alias("_vb"))
    both = pairs.join(left, F.col(a) == F.col("_ta"), "left").join(right, F.col(b) == F.col("_tb"), "left")
    score = F.when(F.col("_va").isNotNull() & F.col("_vb").isNotNull(), cosine(F.col("_va"), F.col("_vb"), mapping))
    return both.withColumn(out, score).drop("_ta", "_va", "_tb", "_vb")
