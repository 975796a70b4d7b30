"""N-gram Jaccard self-join: a MinHash LSH forest proposes groups, exact Jaccard verifies within them."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._clusters import blocks, components, linked, paired, told
from tessera.llm._common import documents, written, written_and_told
from tessera.llm._words import batches, mixed, shingles, word_hashes


def forest_depth(trees: int, deepest: int, least: float, recall: float) -> int:
    """How far matched prefixes are shortened: from ``deepest`` up the tries until a pair at ``least`` similarity shares
    a prefix in one of ``trees`` tries with probability ``recall`` or more.
    """
    for depth in range(deepest, 1, -1):
        if 1 - (1 - least**depth) ** trees >= recall:
            return depth
    return 1


def signatures(sets: list[np.ndarray], size: int, seed: int) -> np.ndarray:
    """MinHash signatures (n, size) of non-empty sets of 64-bit hashes, by multiply-add hashing on 32 bits."""
    rng = np.random.default_rng(seed)
    times = rng.integers(0, 1 << 31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    plus = rng.integers(0, 1 << 32, size, dtype=np.uint64).astype(np.uint32)
    out = np.empty((len(sets), size), np.uint32)
    for part in batches(map(len, sets), 1 << 15):
        chosen = sets[part]
        x = (np.concatenate(chosen) >> np.uint64(32)).astype(np.uint32)
        first = np.concatenate([[0], np.cumsum([len(s) for s in chosen])[:-1]])
        for k in range(size):
            out[part, k] = np.minimum.reduceat(x * times[k] + plus[k], first)
    return out


def trie_nodes(entries: DataFrame, deepest: int, required: int, at_once: int = 1 << 20) -> DataFrame:
    """(keys, node): the trie nodes of depths ``required`` to ``deepest`` over each row of ``entries`` (tree, label, node) that
    may have company at ``required``.

    All labels (``deepest`` values of 2 bytes) are sorted by tree and value over range partitions, whose bounds also look
    at ``node``, so equal labels are spread. Sorted so, a trie node of depth d is a run of rows whose neighbours have d
    values in common. A row whose run at ``required`` is itself alone falls away here; one at the edge of a partition or of what is
    looked at at once stays, as its run may go on there. So what a key gathers doesn't hang on how rows are dealt.
    """

    def climb(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= at_once:
                yield nodes(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield nodes(pa.Table.from_batches(held))

    def nodes(rows: pa.Table) -> pa.RecordBatch:
        tree, node = rows.column("tree").to_numpy(), rows.column("node").to_numpy()
        label = np.frombuffer(b"".join(rows.column("label").to_pylist()), "<u2").reshape(len(rows), deepest)
        same = (tree[1:] == tree[:-1]) & (label[1:, :required] == label[:-1, :required]).all(axis=1)
        run = np.concatenate([[0], np.cumsum(~same)])
        wanted = (np.bincount(run)[run] > 1) | (run == 0) | (run == run[-1])
        tree, label, node = tree[wanted], label[wanted], node[wanted]
        keys = np.empty((len(node), deepest - required + 1), np.uint64)
        key = mixed(tree.astype(np.uint64) * np.uint64(64) + np.uint64(deepest))
        for depth in range(1, deepest + 1):
            key = mixed(key ^ label[:, depth - 1].astype(np.uint64))
            if depth >= required:
                keys[:, depth - required] = mixed(key + np.uint64(depth))
        offsets = pa.array(np.arange(len(node) + 1, dtype=np.int32) * keys.shape[1], pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64)))
        return pa.RecordBatch.from_arrays([lists, pa.array(node)], names=["keys", "node"])

    dealt = entries.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label")
    return dealt.mapInArrow(climb, "keys array<long>, node long")


def shortened(under: DataFrame, levels: int, crowd: int) -> DataFrame:
    """(root, id): the node of each row of ``under`` (keys from the shortest prefix to the whole label) in which it is compared.

    A prefix is shortened to the first of ``levels`` depths, where the recall is reached, unless more than ``crowd`` rows are
    under it there: then to the second, and so on; the last is taken however many it has. Rows alone in their node fall away.
    Nodes are counted over all rows by a grouped sum.
    """
    out, rest = [], under
    for level in range(levels):
        key = F.get("keys", F.lit(level)).alias("root")
        counts = rest.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
        met = rest.select("keys", "node", key).join(counts, "root")
        last = level == levels - 1
        out.append((met if last else met.where(F.col("rows") <= crowd)).select("root", F.col("node").alias("id")))
        if not last:
            rest, told = written_and_told(met.where(F.col("rows") > crowd).select("keys", "node"), "forest-crowded", F.count(F.lit(1)).alias("n"))
            if not told["n"]:
                break
    return reduce(DataFrame.unionByName, out)


def link_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    least: float = 0.8,
    trees: int = 28,
    deepest: int = 8,
    recall: float = 0.9995,
    seed: int = 17,
    rows_per_block: int = 192,
    text_key: bool = False,
) -> DataFrame:
    """Links between documents whose sets of ``n``-word shingles have a Jaccard similarity of ``least`` or more.

    Words are runs of anything but white space, A-Z lowered; a text of fewer than ``n`` words is one shingle. Texts of
    equal shingle sets are one class, with a count, so copies are never expanded. The forest has ``trees`` tries, each
    over ``deepest`` values of the class's MinHash signature. Prefixes are shortened from ``deepest`` up to the
    depth at which a pair at ``least`` shares one with probability ``recall`` or more (6 of 8 values in 28 trees: 0.9998); where
    more than ``rows_per_block`` rows are under such a prefix, it stays one value longer, or two (``shortened``). A pair that meets
    crowds in all trees shares 7 values of one with 0.9986, all 8 with 0.994. Rows under one node are compared by their signatures, block against block; pairs
    whose estimated similarity is not more than five standard deviations under ``least`` join a group. All pairs of a
    group are verified by exact Jaccard, block against block. Nothing is capped: a large node or group is more blocks.

    Returns id, rep_id (smallest id of the same shingle set), class_id (smallest id that links lead to), n_links
    (other documents linked directly, copies included), kept (this id is class_id), and the MD5 of the text if
    ``text_key`` is asked for. Null and empty texts, texts without words and null ids link with nothing. Rows that repeat
    an id are rows of their own, with one text or several; each has its result. An empty table gives an empty one. Other columns aren't read.
    """
    depth = forest_depth(trees, deepest, least, recall)
    size = trees * deepest
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.md5(F.col("text").cast("binary")))

    def shingled(texts: pa.Array) -> list[np.ndarray]:
        return [shingles(word_hashes((t.as_py() or "").encode("utf-8", "replace")), n) for t in texts]

    def keyed(batches):
        for batch in batches:
            for part in (batch.slice(at, 2048) for at in range(0, len(batch), 2048)):
                sets = shingled(part.column(1))
                full = [at for at, (i, s) in enumerate(zip(part.column(0), sets)) if len(s) and i.is_valid]
                prints: list = [None] * len(sets)
                signs: list = [None] * len(sets)
                if full:
                    for at, own in zip(full, signatures([sets[at] for at in full], size, seed)):
                        prints[at] = hashlib.blake2b(sets[at].tobytes(), digest_size=16).hexdigest()
                        signs[at] = (own >> np.uint32(16)).astype("<u2").tobytes()
                arrays = [part.column(0), part.column(2), pa.array(prints, pa.string()), pa.array([len(s) for s in sets], pa.int64()), pa.array(signs, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "text_key", "print", "size", "signature"])

    marked = written(rows.mapInArrow(keyed, "id long, text_key string, print string, size long, signature binary"), "forest-signatures")
    classes = marked.where(F.col("print").isNotNull()).groupBy("print")
    classes = classes.agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"), F.min_by(F.struct("text_key", "signature"), "id").alias("own"))
    classes = written(classes.select("print", "rep", "copies", "size", "own.*", F.monotonically_increasing_id().alias("node")), "forest-classes")

    labels = F.posexplode(F.array(*(F.substring("signature", 2 * deepest * t + 1, 2 * deepest) for t in range(trees)))).alias("tree", "label")
    under = written(trie_nodes(classes.select("node", labels), deepest, depth), "forest-nodes")
    under = written(shortened(under, deepest - depth + 1, rows_per_block), "forest-met").withColumn("weight", F.lit(1).cast("long"))
    dealt = blocks(under, rows_per_block, rows_per_block).drop("weight").withColumn("copies", F.lit(1).cast("long"))
    dealt = dealt.join(classes.select(F.col("node").alias("id"), "signature"), "id")
    under_least = least - 5 * (least * (1 - least) / size) ** 0.5

    def alike(left: pa.Table, right: pa.Table) -> np.ndarray:
        a, b = (np.frombuffer(b"".join(t.column("signature").to_pylist()), "<u2").reshape(len(t), size) for t in (left, right))
        same = np.zeros((len(a), len(b)), np.int32)
        for k in range(size):
            same += a[:, k, None] == b[None, :, k]
        return same >= under_least * size

    _, edges = linked(paired(dealt), alike)
    near = components(edges, "forest-groups")
    members = classes.join(near, F.col("node") == F.col("id"))

    def as_sets(batches):
        for batch in batches:
            sets = [s.tobytes() for s in shingled(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    wanted = members.select(F.col("rep").alias("own"), F.col("text_key").alias("own_key"), "node")
    wanted = rows.join(wanted, (F.col("id") == F.col("own")) & (F.col("text_key") == F.col("own_key"))).select("node", "text")
    wanted = wanted.mapInArrow(as_sets, "id long, shingles binary").dropDuplicates(["id"])
    dealt = blocks(members.select("id", "root", "copies", F.col("size").alias("weight")), rows_per_block, 1 << 21).drop("weight").join(wanted, "id")

    def similar(left: pa.Table, right: pa.Table) -> np.ndarray:
        return jaccard(left.column("shingles").to_pylist(), right.column("shingles").to_pylist()) >= least - 1e-12

    counts, edges = linked(paired(dealt), similar)
    more = ["text_key"] if text_key else []
    return told(marked, classes, counts, components(edges, "forest-links"), *more).withColumnRenamed("rep", "rep_id")


def jaccard(left: list[bytes], right: list[bytes], columns: int = 4096) -> np.ndarray:
    """Jaccard similarities of sets given as bytes of 64-bit hashes: products of incidence matrices, some columns at a time."""
    sets = [np.frombuffer(s, np.uint64) for s in left] + [np.frombuffer(s, np.uint64) for s in right]
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times[column] > 1
    owner, column = owner[several], column[several]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(left), len(right)), np.float64)
    used, dense = np.unique(column, return_inverse=True)
    for at in range(0, len(used), columns):
        a, b = np.searchsorted(dense, [at, at + columns])
        m = np.zeros((len(sets), min(columns, len(used) - at)), np.float32)
        m[owner[a:b], dense[a:b] - at] = 1
        common += m[: len(left)] @ m[len(left) :].T
    union = sizes[: len(left), None] + sizes[None, len(left) :] - common
    return common / np.maximum(union, 1)


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with their own columns, that are the smallest doc_id of their class; rows with a null
    doc_id stay, and of rows that repeat a kept doc_id with the same text all stay. Any other columns may be there.
    """
    found = link_documents(docs, text_key=True, **options).where(~F.col("kept"))
    gone = found.select(F.struct("id", "text_key").alias("key")).distinct()
    own = F.struct(docs["doc_id"].cast("long").alias("id"), F.md5(docs["text"].cast("string").cast("binary")).alias("text_key"))
    return docs.join(gone, own == gone["key"], "left_anti")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
