"""Stored postings in segments, whose blocks tell the greatest score they can give, so that a search skips most."""

from __future__ import annotations

import uuid
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.tokens import counted_terms, parts
from tessera.operators.retrieval import B, K1, KEY, TOKEN, SearchFilter, query_terms
from tessera.operators.snapshots import LostUpdate, Snapshots

#: Postings that a worker puts into blocks at once.
MOST_POSTINGS = 1 << 18
FILTERS = ("collection", "page_type", "source_format", "agent_handle", "memory_type")


class Found(NamedTuple):
    """hits: (key, score), best first; how many blocks of the query's terms there are, and how many of them were read."""

    hits: DataFrame
    blocks: int
    read: int


def part(tf: Column, length: Column, average: float) -> Column:
    """What a term of weight 1 adds to the score of a row."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(average)))


def _blocks_of(rows: DataFrame, zone: int) -> DataFrame:
    """(term, zone, packed): the blocks of ``rows`` as they lie in their files, so that no posting is shuffled by itself;
    ``packed`` has the places of its rows in the zone, then their tfs, then their lengths. A zone that a task's or a batch's end
    cuts has two blocks of a term, which a search adds up; its bound is no less.
    """

    def made(batches):
        for batch in batches:
            row = batch.column("row").to_numpy()
            lengths = pa.compute.fill_null(batch.column("length"), 0).to_numpy(zero_copy_only=False)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(batch.column("terms")), 0).to_numpy(zero_copy_only=False)
            begins = np.append(np.flatnonzero(np.diff(row // zone, prepend=-1)), len(row))
            for first, end in parts(np.add.reduceat(sizes, begins[:-1]) if len(row) else sizes, MOST_POSTINGS):
                piece = slice(begins[first], begins[end])
                flat = batch.column("terms").slice(piece.start, piece.stop - piece.start).flatten()
                words = flat.field("term").dictionary_encode()
                if not len(words):
                    continue
                at = np.repeat(np.arange(piece.start, piece.stop), sizes[piece])
                code, zones = words.indices.to_numpy(), row[at] // zone
                order = np.lexsort([at, code, zones])
                at, code, zones, tf = at[order], code[order], zones[order], flat.field("tf").to_numpy()[order]
                starts = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(zones, prepend=-1) != 0))
                n = np.diff(np.append(starts, len(code)))
                begin = np.repeat(starts, n)
                place = begin * 3 + np.arange(len(code)) - begin
                packed = np.empty(3 * len(code), np.int32)
                for k, values in enumerate((row[at] % zone, tf, lengths[at])):
                    packed[place + k * np.repeat(n, n)] = values
                listed = pa.ListArray.from_arrays(pa.array(np.append(starts, len(code)).astype(np.int32) * 3), pa.array(packed))
                yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[starts])), pa.array(zones[starts]), listed], names=["term", "zone", "packed"])

    return rows.select("row", "length", "terms").mapInArrow(made, "term string, zone long, packed array<int>")


def _unpacked(zone: int) -> list[Column]:
    """postings (row, tf, length), most_tf, least_length and n of a block."""
    n = (F.size("packed") / 3).cast("int")
    place, tf, length = (F.slice("packed", n * k + 1, n) for k in range(3))
    row = F.transform(place, lambda p: F.col("zone") * zone + p)
    postings = F.arrays_zip(row.alias("row"), tf.alias("tf"), length.alias("length")).cast("array<struct<row:bigint,tf:int,length:int>>")
    return [postings.alias("postings"), F.array_max(tf).alias("most_tf"), F.array_min(length).alias("least_length"), n.cast("long").alias("n")]


class WordIndex:
    """Segments of postings in ``folder``, listed by snapshots.

    A segment has ``rows`` (row, key, filter columns, length, terms) in order of length, which keeps the
    bounds tight, and ``blocks``: for a term and a zone, which
    is a run of ``zone`` rows, the postings (row, tf, length), with the greatest tf and the least length, which bound what the
    block can add to a score under any statistics. Blocks are sorted by term over files, so the scan of a search's terms skips the others, and
    reads postings only where it has to.

    ``add`` writes one more segment, and for the documents that it replaces the rows that are dead now, so that a sync pays
    for what has changed. ``merge`` makes one segment of all from their rows, without their texts. Statistics are those of the living rows.
    """

    def __init__(self, spark: SparkSession, folder: str, key: tuple[str, ...] = KEY, zone: int = 64):
        self.spark, self.folder, self.key, self.zone = spark, folder.rstrip("/"), key, zone
        self._snapshots = Snapshots(spark, self.folder, "index")

    # segments

    def segments(self) -> list[dict[str, Any]]:
        return self._snapshots.latest({"segments": []})[1]["segments"]

    def _rows(self, segment: dict[str, Any]) -> DataFrame:
        return self.spark.read.parquet(f"{segment['folder']}/rows")

    def _dead(self, segment: dict[str, Any]) -> DataFrame | None:
        return self.spark.read.parquet(*segment["dead"]) if segment["dead"] else None

    def _living(self, segment: dict[str, Any]) -> DataFrame:
        dead = self._dead(segment)
        return self._rows(segment) if dead is None else self._rows(segment).join(dead.select("row"), "row", "left_anti")

    def _write(self, rows: DataFrame) -> dict[str, Any]:
        """A segment of ``rows`` (key, filter columns, length, terms)."""
        folder = f"{self.folder}/segment-{uuid.uuid4().hex}"
        columns = [*self.key, *(c for c in FILTERS if c not in self.key)]
        # Terms travel as one string (a token has no space) and an array, which are a third of an array of structs.
        sent = rows.select(*columns, "length", F.array_join("terms.term", " ").alias("_terms"), F.col("terms.tf").alias("tf"))
        sent = sent.repartitionByRange("length", *self.key).sortWithinPartitions("length", *self.key)
        named = F.when(F.size("tf") > 0, F.split("_terms", " ")).otherwise(F.array().cast("array<string>"))
        ordered = sent.withColumn("term", named).select(*columns, "length", F.arrays_zip("term", "tf").alias("terms"))
        ordered.withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")
        blocks = _blocks_of(self.spark.read.parquet(f"{folder}/rows"), self.zone).repartitionByRange("term", "zone").sortWithinPartitions("term", "zone")
        blocks.select("term", "zone", *_unpacked(self.zone)).write.parquet(f"{folder}/blocks")
        return {"folder": folder, **self._statistics(f"{folder}/rows"), "dead": []}

    def _statistics(self, folder: str) -> dict[str, int]:
        """Of the rows in ``folder``: how many, how many with a text, and the sum of their lengths."""
        told = self.spark.read.parquet(folder).agg(F.count(F.lit(1)).alias("n"), F.count("length").alias("texts"), F.coalesce(F.sum("length"), F.lit(0)).alias("total"))
        return {k: int(v) for k, v in told.first().asDict().items()}

    def _tokenized(self, chunks: DataFrame) -> DataFrame:
        have = set(chunks.columns)
        columns = [*self.key, *(c for c in FILTERS if c not in self.key)]
        rows = chunks.select(*(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns), F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)).alias("tokens"))
        return counted_terms(rows.withColumn("length", F.when(F.col("tokens").isNotNull(), F.size("tokens"))))

    def add(self, chunks: DataFrame, gone: DataFrame | None = None) -> int:
        """A segment of ``chunks``; rows of the documents ``gone`` (collection, document_name) in earlier ones are dead. Number of the snapshot."""
        made = self._write(self._tokenized(chunks))
        while True:
            version, state = self._snapshots.latest({"segments": []})
            after = [dict(s) for s in state["segments"]]
            for segment in after if gone is not None else []:
                dead = self._living(segment).join(gone.select("collection", "document_name").distinct(), ["collection", "document_name"], "left_semi")
                folder = f"{self.folder}/dead-{uuid.uuid4().hex}"
                dead.select("row", "length", "terms").write.parquet(folder)
                told = self._statistics(folder)
                if told["n"]:
                    segment.update({k: segment[k] - v for k, v in told.items()}, dead=[*segment["dead"], folder])
            try:
                return self._snapshots.commit({"segments": [*after, made]}, version)
            except LostUpdate:
                continue

    def merge(self, most_segments: int = 1) -> bool:
        """One segment of all if there are more than ``most_segments``; whether it was done."""
        while True:
            version, state = self._snapshots.latest({"segments": []})
            if len(state["segments"]) <= most_segments:
                return False
            made = self._write(reduce(DataFrame.unionByName, [self._living(s) for s in state["segments"]]))
            try:
                self._snapshots.commit({"segments": [made]}, version)
                return True
            except LostUpdate:
                continue

    # search

    def top_k(self, query: str, k: int, where: SearchFilter = SearchFilter(), first: int = 16) -> Found:
        """The ``k`` best living rows by BM25 that pass the filter, ties by key, and how much was read for it.

        Zones are ranked by the greatest score that their blocks of the query's terms allow together. The ``first`` best are
        scored; the score of the k-th of their rows is a bound, and of the others only zones that can reach it are read. So the
        rows are those of scoring everything.
        """
        segments, terms = self.segments(), query_terms(query)
        n, texts, total = (sum(s[k] for s in segments) for k in ("n", "texts", "total"))
        empty = self.spark.createDataFrame([], ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in self._key_fields(segments)), "score double"]))
        if not (segments and terms and n):
            return Found(empty, 0, 0)
        average = total / max(1, texts) or 1.0
        heads = reduce(DataFrame.unionByName, [self._blocks(at, s).where(F.col("term").isin(terms)).drop("postings") for at, s in enumerate(segments)])
        df = {r["term"]: r["n"] for r in heads.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each term of the query
        for segment in segments:
            dead = self._dead(segment)
            if dead is not None:
                lost = dead.select(F.explode("terms").alias("t")).select("t.term").where(F.col("term").isin(terms)).groupBy("term").count()
                for r in lost.collect():
                    df[r["term"]] -= r["count"]
        idf = {t: float(np.log(1 + (n - d + 0.5) / (d + 0.5))) for t, d in df.items() if d > 0}
        if not idf:
            return Found(empty, 0, 0)
        weight = F.create_map(*[F.lit(v) for pair in sorted(idf.items()) for v in pair])[F.col("term")]
        most = F.sum(weight * part(F.col("most_tf"), F.col("least_length"), average))
        zones = heads.where(F.col("term").isin(list(idf))).groupBy("segment", "zone").agg(most.alias("bound"), F.count(F.lit(1)).alias("blocks"))
        blocks = zones.agg(F.sum("blocks")).first()[0]
        best = zones.orderBy(F.desc("bound"), "segment", "zone").limit(first).collect()
        chosen = [(r["segment"], r["zone"]) for r in best]
        scored = self._scored(segments, idf, average, where, chosen).persist()
        try:
            reached = scored.orderBy(F.desc("score")).select("score").limit(k).collect()
            top = self._top(scored, k).collect()  # k rows
        finally:
            scored.unpersist()
        least = reached[-1]["score"] if len(reached) == k else float("-inf")
        read = sum(r["blocks"] for r in best)
        at_hand = self.spark.createDataFrame(top, empty.schema)
        if len(best) < first:
            return Found(at_hand, blocks, read)
        place = F.struct("segment", "zone")
        rest = zones.where((F.col("bound") >= least - 1e-9) & ~place.isin([F.struct(F.lit(a), F.lit(b).cast("long")) for a, b in chosen]))
        more = rest.agg(F.sum("blocks")).first()[0] or 0
        if more:
            others = self._scored(segments, idf, average, where, rest.select("segment", "zone"))
            at_hand = self._top(at_hand.unionByName(others.select(*at_hand.columns)), k)
        return Found(at_hand, blocks, read + more)

    def _key_fields(self, segments: list[dict[str, Any]]):
        if not segments:
            return [f for f in self.spark.createDataFrame([], "document_name string, page_number int, chunk_index int").schema]
        return [self._rows(segments[0]).schema[c] for c in self.key]

    def _blocks(self, at: int, segment: dict[str, Any]) -> DataFrame:
        return self.spark.read.parquet(f"{segment['folder']}/blocks").withColumn("segment", F.lit(at))

    def _top(self, scored: DataFrame, k: int) -> DataFrame:
        return scored.select(*self.key, "score").orderBy(F.desc("score"), *self.key).limit(k)

    def _scored(self, segments: list[dict[str, Any]], idf: dict[str, float], average: float, where: SearchFilter, zones: list[tuple[int, int]] | DataFrame) -> DataFrame:
        """(key, score) of the living rows of ``zones`` that pass the filter and have a term."""
        out = []
        for at, segment in enumerate(segments):
            blocks = self._blocks(at, segment).where(F.col("term").isin(list(idf)))
            if isinstance(zones, list):
                own = [z for s, z in zones if s == at]
                if not own:
                    continue
                blocks = blocks.where(F.col("zone").isin(own))
            else:
                blocks = blocks.join(zones.where(F.col("segment") == at).select("zone"), "zone", "left_semi")
            weight = F.create_map(*[F.lit(v) for pair in sorted(idf.items()) for v in pair])[F.col("term")]
            rows = blocks.select("term", F.explode("postings").alias("p")).select(weight.alias("weight"), "p.*")
            scores = rows.groupBy("row").agg(F.round(F.sum(F.col("weight") * part(F.col("tf"), F.col("length"), average)), 9).alias("score"))
            kept = self._living(segment).where(where.predicate()).select("row", *self.key)
            out.append(kept.join(scores, "row").select(*self.key, "score"))
        return reduce(DataFrame.unionByName, out)
