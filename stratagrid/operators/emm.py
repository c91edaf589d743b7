"""An encrypted multimap: label -> record ids, as a table of (label hash, encrypted id) rows.

Entry i of a keyword's list lies under H(t | i) with the keyword's token t = H(key | keyword); its value is the id under
AES. A client sends tokens; the server derives the labels of entries 0, 1, ... and joins them with the table."""

from __future__ import annotations

import statistics
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.functions import crypto
from stratagrid.operators.ranks import id_part, rank_within


@dataclass(frozen=True)
class Keys:
    """Parameters, not secrets of this library."""

    token: str = "token-key"
    value: str = "value-key"

    def aes(self) -> Column:
        return crypto.sha256(F.lit(self.value))


def token(keyword: Column, keys: Keys = Keys()) -> Column:
    """The keyword's token, as hex."""
    return crypto.sha256_hex(F.lit(keys.token), keyword)


def entry(token_: Column, i: Column) -> Column:
    return crypto.sha256(token_, i.cast("string"))


def build(postings: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """(ct_label, ct_value) of postings (label, record_id). Entries are numbered within a keyword in the order of the
    record ids, so the table is the same in every run."""
    rows = postings.select("label", "record_id")
    numbered = rank_within(rows, ["label"], ["record_id"], id_part(rows), "i")
    return numbered.select(entry(token(F.col("label"), keys), F.col("i")).alias("ct_label"), crypto.encrypt(F.col("record_id"), keys.aes()).alias("ct_value"))


def tokens(keywords: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """(query_id, token) of (query_id, label): each token once for a query."""
    return keywords.select("query_id", token(F.col("label"), keys).alias("token")).distinct()


def lookup(index: DataFrame, asked: DataFrame, counts: DataFrame) -> DataFrame:
    """(query_id, ct_value) of tokens: as many entries as ``counts`` (token, n) has for each, joined by label. Unknown
    tokens have none; counts hold no keywords and no ids."""
    known = asked.join(counts, "token")
    each = known.select("query_id", "token", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"))
    labels = each.select("query_id", entry(F.col("token"), F.col("i")).alias("ct_label"))
    return index.join(labels, "ct_label").select("query_id", "ct_value")


def token_counts(postings: DataFrame, keys: Keys = Keys()) -> DataFrame:
    return postings.groupBy("label").agg(F.count("*").alias("n")).select(token(F.col("label"), keys).alias("token"), "n")


def decrypt(found: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """(query_id, record_id): what can't be decrypted is left out; an id counts once for a query."""
    plain = found.select("query_id", crypto.decrypt(F.col("ct_value"), keys.aes()).alias("text"))
    return plain.select("query_id", F.expr("try_cast(text as bigint)").alias("record_id")).where("record_id is not null").distinct()


def storage(index: DataFrame) -> DataFrame:
    """Entries, and bytes of labels and values."""
    return index.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.length("ct_label")), F.lit(0)).alias("label_bytes"), F.coalesce(F.sum(F.length("ct_value")), F.lit(0)).alias("value_bytes"))


class EncryptedStore:
    """Build once, store, query by label, measure."""

    def __init__(self, postings: DataFrame | None, keys: Keys = Keys(), index: DataFrame | None = None, counts: DataFrame | None = None) -> None:
        self.keys = keys
        self.index = build(postings, keys) if index is None else index
        self.counts = token_counts(postings, keys) if counts is None else counts

    def save(self, path: str) -> EncryptedStore:
        """Writes the index and the counts, and returns the store that reads them."""
        self.index.write.mode("overwrite").parquet(f"{path}/index")
        self.counts.write.mode("overwrite").parquet(f"{path}/counts")
        return self.load(self.index.sparkSession, path, self.keys)

    @classmethod
    def load(cls, spark: SparkSession, path: str, keys: Keys = Keys()) -> EncryptedStore:
        return cls(None, keys, spark.read.parquet(f"{path}/index"), spark.read.parquet(f"{path}/counts"))

    def benchmark(self, keywords: DataFrame, repeats: int = 3) -> dict[str, float]:
        """Seconds of a query of all ``keywords`` (the median of ``repeats``), its rows, and the index's entries and bytes."""
        times = []
        for _ in range(repeats):
            began = time.time()
            rows = self.query(keywords).count()
            times.append(time.time() - began)
        size = self.size().first()
        return {"seconds": statistics.median(times), "rows": rows, "entries": size.entries, "bytes": size.label_bytes + size.value_bytes}

    def query(self, keywords: DataFrame) -> DataFrame:
        return decrypt(lookup(self.index, tokens(keywords, self.keys), self.counts), self.keys)

    def size(self) -> DataFrame:
        return storage(self.index)
