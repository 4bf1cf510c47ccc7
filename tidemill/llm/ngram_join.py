"""N-gram Jaccard join with signature trees.

1. Each text becomes its set of distinct word shingles (64-bit hashes). Equal
   sets are one node from here on, however many documents have them.
2. A node sends keys: two hashes that follow each other among its PREFIX
   smallest. Two sets at the threshold share such a key but for a chance under
   1e-11 (for up to PREFIX shingles, always; see ``PREFIX``). Nodes that share
   no key with another leave.
3. Nodes that share a key are a block. A block is joined by a signature tree
   (``signature_tree``), which skips pairs of one component and checks what
   its bitmaps allow exactly. The first two passes take each node's first two
   keys only, so a group of near copies, which would meet under dozens of
   keys, is one component before the last pass takes all keys; there a block
   counts only while it holds more than one component.
4. Components come from the links by joins (``components``).

A block above BLOCK_BYTES of text is cut: by size class, since the size of a
set bounds its partners, then into chunks that meet in pairs, each a task's
work of bounded memory. Nothing else is split, dropped or capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import repeats, signature_tree
from .components import merge
from .tables import keep, small, width
from .text import mix, shingle_sets, signed, texts

# At similarity 0.75 the chance that no two neighbours of the 56 smallest are shared is below 0.576 ** 56 < 4e-14.
PREFIX = 56
BLOCK_BYTES = 8 << 20
_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("keys", pa.list_(pa.int64()))])


def _node(s: np.ndarray) -> int:
    """A 64-bit name of a set; equal sets have equal names."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _keys(s: np.ndarray) -> np.ndarray:
    head = s[:PREFIX]
    return signed(mix(head[:-1] * np.uint64(0x9E3779B97F4A7C15) + head[1:]))


def shingled(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, node (null without shingles) and keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts(batch.column("text"), lower=True):
                sizes, nodes, keys = [], [], []
                for s in shingle_sets(part, words):
                    sizes.append(len(s))
                    nodes.append(_node(s) if len(s) else None)
                    keys.append(_keys(s) if len(s) > 1 else np.zeros(0, np.int64))
                ids = batch.column("doc_id").slice(part.first, len(part)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, _SETS.field("keys").type)], schema=_SETS)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, node bigint, keys array<bigint>")


def noded(df: DataFrame, words: int) -> DataFrame:
    """``df``, all columns, with the node of each row's text (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (s for part in texts(batch.column("text"), lower=True) for s in shingle_sets(part, words))
            yield batch.append_column("node", pa.array([_node(s) if len(s) else None for s in sets], pa.int64()))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("node", T.LongType())]))


def _emit_keys(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    keys = batch.column("keys")
    nodes = np.repeat(batch.column("node").to_numpy(), keys.value_lengths().to_numpy())
    yield keys.flatten().to_numpy().view(np.uint64), nodes


def _candidates(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """Nodes that share a key with another: node, bytes, n, text and the shared keys in prefix order."""
    shared = repeats.by_document(repeats.shared_keys(nodes.select("node", "keys"), _emit_keys, first_too=True), "shared")
    held = nodes.join(shared.withColumnRenamed("doc_id", "node"), "node")
    held = held.select("node", "low", F.array_intersect("keys", "shared").alias("keys"))
    found = docs.select(F.col("doc_id").alias("low"), "text").join(held, "low").select("node", "text", "keys")
    # sets that only rows without doc_id hold
    lost = noded(docs.where("doc_id IS NULL").select("text"), words).join(held.where("low IS NULL").select("node", "keys"), "node")
    found = found.unionByName(lost.groupBy("node").agg(F.first("text").alias("text"), F.first("keys").alias("keys")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows that repeat a doc_id may hold another text
        for batch in batches:
            sets = [s for part in texts(batch.column("text"), lower=True) for s in shingle_sets(part, words)]
            own = [len(s) > 0 and _node(s) == n for s, n in zip(sets, batch.column("node").to_pylist())]
            out = batch.append_column("n", pa.array([len(s) for s in sets], pa.int64())).filter(pa.array(own, pa.bool_()))
            yield out.select(["node", "n", "text", "keys"])

    checked = found.mapInArrow(check, "node bigint, n bigint, text string, keys array<bigint>")
    return keep(checked.withColumn("bytes", F.octet_length("text") + 200), "candidates")


def _blocks(members: DataFrame) -> DataFrame:
    """Members (key, node, comp, n, bytes) of blocks with several components, with the task (key, part) that joins them."""
    found = (
        members.groupBy("key")
        .agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.sum("bytes").alias("all"))
        .where("least <> most")
        .select("key", "all")
    )
    held = members.join(found, "key")
    small = held.where(F.col("all") <= BLOCK_BYTES).select("key", "node", "comp", F.lit("").alias("part"))
    # sizes of linked sets differ by a third at most, so they are in one size class or in neighbours
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(4 / 3))).cast("int")
    large = held.where(F.col("all") > BLOCK_BYTES).withColumn("band", F.explode(F.array(band, band + 1)))
    sums = large.groupBy("key", "band").agg(F.sum("bytes").alias("own"))
    chunks = F.ceil(F.col("own") / F.lit(BLOCK_BYTES)).cast("int")
    large = large.join(sums, ["key", "band"]).withColumn("k", chunks).withColumn("c", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    large = large.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    part = F.concat_ws(":", "band", F.least("c", "o"), F.greatest("c", "o"))
    return small.unionByName(large.select("key", "node", "comp", part.alias("part")))


def _join_blocks(blocks: DataFrame, held: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between nodes of different components in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, nodes, comps, sets = None, [], [], []

        def end() -> list[tuple[int, int]]:
            own = [k for k in range(len(nodes)) if k == 0 or nodes[k] != nodes[k - 1]]  # a node can hold a key twice
            if len(own) < 2:
                return []
            names = [nodes[k] for k in own]
            return [(names[i], names[j]) for i, j in signature_tree.links([sets[k] for k in own], np.array([comps[k] for k in own]), percent)]

        for batch in batches:
            found = []
            rows = zip(batch.column("key").to_pylist(), batch.column("part").to_pylist(), batch.column("node").to_pylist(), batch.column("comp").to_pylist())
            made = (s for part in texts(batch.column("text"), lower=True) for s in shingle_sets(part, words))
            for (key, piece, node, comp), s in zip(rows, made):
                if (key, piece) != block:
                    found += end()
                    block, nodes, comps, sets = (key, piece), [], [], []
                nodes.append(node)
                comps.append(comp)
                sets.append(s)
            if found:
                yield pa.RecordBatch.from_pydict({"a": [a for a, _ in found], "b": [b for _, b in found]})
        found = end()
        if found:
            yield pa.RecordBatch.from_pydict({"a": [a for a, _ in found], "b": [b for _, b in found]})

    dealt = blocks.join(held.select("node", "text"), "node").repartition(width(blocks.sparkSession), "key", "part")
    return dealt.sortWithinPartitions("key", "part", "node").select("key", "part", "node", "comp", "text").mapInArrow(run, "a bigint, b bigint")


def _classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows' doc_id, n_shingles and node; and (node, comp, component): each node's component, by its smallest node and doc_id."""
    rows = keep(shingled(docs, words), "shingled")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.first("keys").alias("keys"))
    nodes = keep(nodes, "nodes")
    held = _candidates(docs, nodes, words)
    labels = None
    for step in range(3):
        key = F.explode("keys") if step == 2 else F.get("keys", F.lit(step))
        members = held.select(key.alias("key"), "node", "n", "bytes").where("key is not null")
        if labels is None:
            members = members.withColumn("comp", F.col("node"))
        else:
            members = members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        found = keep(_join_blocks(_blocks(members), held, words, percent), "links")
        labels = merge(labels, found)
    low = nodes.select("node", "low").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    return rows, low.join(low.groupBy("comp").agg(F.min("low").alias("component")), "comp").select("node", "comp", "component")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """Each row's class of near duplicates: doc_id, n_shingles, component_id.

    ``docs`` has doc_id and text; other columns are left out. A-Z counts as
    a-z. Two documents link when their shingle sets have a Jaccard similarity
    of ``percent`` / 100 or more; component_id is the smallest doc_id reachable
    by links. A text with fewer words than ``words`` is one shingle; a null or
    empty text, or one of white space, has none and is linked with nothing.
    Rows that repeat a doc_id are judged by their own texts. A row without
    doc_id has no component_id, but links through it count.
    """
    rows, classes = _classes(docs, words, percent)
    return rows.join(classes.select("node", "component"), "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    )


def keep_first(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """``docs``, all columns, with one row of each group of near duplicates: of the smallest doc_id, a row without one coming last.

    Rows are judged by their own texts, so unlike texts that share a doc_id both
    stay; of rows alike in doc_id and text one stays. Rows without words are in
    no group: those without doc_id stay, of those that share one, one stays.
    """
    rows, classes = _classes(docs, words, percent)
    found = keep(rows.select("doc_id", "node").join(classes.select("node", "comp"), "node", "left"), "rows")
    # of each group the first row; a row without words is a group of its own
    firsts = found.where("node IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("f")).select("f.doc_id", "f.node")
    firsts = keep(firsts, "firsts")
    counts = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.count("node").alias("m"))
    winners = firsts.where("doc_id IS NOT NULL").select("doc_id").distinct().withColumn("wins", F.lit(True))
    alone = counts.where("n = 1").join(winners, "doc_id", "left").where("wins OR m = 0").select("doc_id")
    plain = docs.join(alone, "doc_id", "left_semi").select(*docs.columns)
    # rows that a doc_id does not tell apart go by their text as well
    several = docs.join(small(counts.where("n > 1").select("doc_id"), "repeated"), "doc_id", "left_semi").select(*docs.columns)
    odd = noded(several.unionByName(docs.where("doc_id IS NULL")).withColumnsRenamed({c: f"c_{i}" for i, c in enumerate(docs.columns) if c != "text"}), words)
    doc = f"c_{docs.columns.index('doc_id')}"
    named = odd.where(F.col("node").isNotNull()).join(
        firsts.select(F.col("doc_id").alias("first_doc"), F.col("node").alias("first_node")), F.col(doc).eqNullSafe(F.col("first_doc")) & (F.col("node") == F.col("first_node"))
    )
    named = named.dropDuplicates([doc, "node"])
    bare = odd.where(F.col("node").isNull())
    bare = bare.where(F.col(doc).isNotNull()).dropDuplicates([doc]).unionByName(bare.where(F.col(doc).isNull()))
    columns = [F.col("text" if c == "text" else f"c_{i}").alias(c) for i, c in enumerate(docs.columns)]
    return plain.unionByName(named.select(*columns)).unionByName(bare.select(*columns))
