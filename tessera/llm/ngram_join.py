"""Jaccard join on word n-grams: a MinHash LSH forest finds candidates, exact comparison decides.

Every text has a signature of ``trees`` x ``LONGEST`` least hashes. For each tree all signatures are sorted as
strings of values, which lays out the tree's prefix trie: texts below a node are neighbours, and the longest common
prefix of neighbours says how deep their node lies. All prefixes start at full length and are shortened value by
value until the expected recall over the links that the forest shows reaches its target. Neighbours that still share
a prefix are tied. Components of these ties that fit a block are compared whole; of larger ones the members of each
node are, in pairs of blocks, a pair that shares several nodes counting in its first tree. Shingle sets are compared
exactly; only link counts and spanning edges leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CACHES, arrow_map, body, join_counted, materialize
from tessera.llm.graph import components

WORDS = 5
THRESHOLD = 0.8
TREES = 32
#: Values of a full prefix, and of the shortest that neighbours are looked at for.
LONGEST, SHORTEST = 10, 4
RECALL = 0.9999
#: The weight of a link at the threshold beside the links seen: such links are the ones that a forest misses first.
AT_THRESHOLD = 0.01
SKETCH_BITS = 128
#: Shingles and texts of a block, on average; a component that fits one is compared whole.
BLOCK_SHINGLES = 400_000
BLOCK_TEXTS = 1_500
CACHE_ENTRIES = 150_000
#: Shingles in more texts of a group than this are counted by a matrix product, others pair by pair.
DENSE = 48


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        self[word] = made = xxhash.xxh64_intdigest(word)
        return made


_HASHES = _Hashes()
CACHES.append(_HASHES)


def shingles(text: bytes, n: int = WORDS) -> np.ndarray:
    """64-bit hashes of the word n-grams, with repeats; a shorter text is one shingle, a text without words none.

    A word is a maximal run of bytes other than space and the five ASCII controls from tab to return.
    """
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    made = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        made = made * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        made ^= made >> np.uint64(29)
    return made * np.uint64(0xBF58476D1CE4E5B9)


def family(size: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, (size, 1), dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, (size, 1), dtype=np.uint32)


def signature(sh: np.ndarray, multiply: np.ndarray, flip: np.ndarray, step: int = 2048) -> np.ndarray:
    """The least value of each function of the family over all shingles."""
    h = (sh >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(multiply), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(h), step):
        least = np.minimum(least, ((h[None, lo : lo + step] ^ flip) * multiply).min(axis=1))
    return least


def strings(sig: np.ndarray, trees: int) -> tuple[bytes, bytes]:
    """The trees' strings of values, two bytes each, and a sketch: a bit of the last values of every tree."""
    values = (sig & np.uint32(0xFFFF)).astype(">u2")
    last = np.resize(sig.reshape(trees, -1)[:, ::-1].T, SKETCH_BITS)
    return values.tobytes(), np.packbits(((last >> np.uint32(7)) & np.uint32(1)).astype(np.uint8)).tobytes()


def found_share(similarity: np.ndarray, length: int, trees: int) -> np.ndarray:
    """The probability that pairs share a prefix of ``length`` in some tree."""
    return 1 - (1 - similarity**length) ** trees


def choose_length(seen: dict[float, int], threshold: float, trees: int, recall: float) -> int:
    """The longest prefix whose expected recall reaches the target: over ``seen`` (links by similarity) and one at the threshold."""
    s = np.array([x for x in seen if x >= threshold])
    n = np.array([seen[x] for x in seen if x >= threshold], np.float64)
    s, weight = np.r_[s, threshold], np.r_[n / n.sum() * (1 - AT_THRESHOLD), AT_THRESHOLD] if len(n) else np.ones(1)
    length = LONGEST
    while length > SHORTEST and weight @ found_share(s, length, trees) < recall:
        length -= 1
    return length


def _keyed(df: DataFrame) -> DataFrame:
    """With a 128-bit key of the text."""
    return df.withColumn("t1", F.xxhash64(body())).withColumn("t2", F.xxhash64(F.lit("second"), body()))


def _texts(docs: DataFrame, n: int, trees: int) -> DataFrame:
    """Different texts: tid, t1, t2, least doc_id, rows, number of shingles, strings and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multiply, flip = family(trees * LONGEST)
        for batch in batches:
            keys, sketches, sizes = [], [], []
            for text in batch.column(3):
                sh = shingles(text.as_py(), n)
                sizes.append(len(sh))
                key, sketch = strings(signature(sh, multiply, flip), trees) if len(sh) else (b"", b"")
                keys.append(key)
                sketches.append(sketch)
            made = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.record_batch([*(batch.column(i) for i in range(3)), *made], names=["doc_id", "t1", "t2", "shingles", "keys", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long"), "t1", "t2", F.encode(body(), "UTF-8").alias("text"))
    made = rows.transform(arrow_map, run, "doc_id long, t1 long, t2 long, shingles long, keys binary, sketch binary")
    first = F.first(F.struct("shingles", "keys", "sketch")).alias("made")
    grouped = made.groupBy("t1", "t2").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"), first)
    return materialize(grouped.select("t1", "t2", "least", "rows", "made.*").withColumn("tid", F.monotonically_increasing_id()), "ngram-texts")


_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tree and string: ties of neighbours (edge 0), texts with a neighbour below some node (edge 3),
    and the first and last row of the task (edge 1 and 2).

    Texts with equal strings are tied to the first of them, others to the one before.
    """
    part = TaskContext.get().partitionId()
    kept = None  # the last row, and the first text that has its string

    def edge(kind: int, row: tuple) -> pa.RecordBatch:
        tree, key, sketch, tid = row
        return _ties([tid], [tid], [0], [0], [kind], [part], [tree], [key], [sketch])

    for batch in batches:
        if not batch.num_rows:
            continue
        tree, tid = (batch.column(c).to_numpy() for c in ("tree", "tid"))
        keys, sketches = ([x.as_py() for x in batch.column(c)] for c in ("key", "sketch"))
        if kept is None:
            yield edge(1, (int(tree[0]), keys[0], sketches[0], int(tid[0])))
            start = (tree[:1] - 1, keys[:1], sketches[:1], tid[:1], tid[:1], np.zeros(1, bool))
        else:
            start = kept
        tree, tid, keys, sketches = np.r_[start[0], tree], np.r_[start[3], tid], start[1] + keys, start[2] + sketches
        lcp, agree = _alike(tree, keys, sketches)
        new = np.flatnonzero(np.r_[True, lcp < LONGEST])
        of = np.searchsorted(new, np.arange(len(tid)), side="right") - 1
        heads = np.r_[start[4], tid[new[1:]]]
        to = np.where(lcp < LONGEST, tid[:-1], heads[of[1:]])
        near = lcp >= SHORTEST
        tied = near & (tid[1:] != to)
        n = int(tied.sum())
        if n:
            yield _ties(tid[1:][tied], to[tied], lcp[tied], agree[tied], [0] * n, [part] * n, [0] * n, [b""] * n, [b""] * n)
        held = np.r_[start[5], near]
        held[:-1] |= near
        held[0] &= not start[5][0]  # told with the batch before
        some = np.flatnonzero(held)
        n = len(some)
        if n:
            yield _ties(tid[some], tid[some], [0] * n, [0] * n, [3] * n, [part] * n, tree[some], [keys[i] for i in some], [b""] * n)
        kept = (tree[-1:], keys[-1:], sketches[-1:], tid[-1:], heads[of[-1:]], near[-1:])
    if kept is not None:
        yield edge(2, (int(kept[0][0]), kept[1][0], kept[2][0], int(kept[3][0])))


_TIES = {"u": "long", "v": "long", "lcp": "int", "agree": "int", "edge": "int", "part": "int", "tree": "int", "key": "binary", "sketch": "binary"}


def _ties(*columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.record_batch([pa.array(c, kinds[k]) for c, k in zip(columns, _TIES.values(), strict=True)], names=list(_TIES))


def _alike(tree: np.ndarray, keys: list[bytes], sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Common values and bits of sketches of each row with the one before it."""
    values = np.frombuffer(b"".join(keys), ">u2").reshape(len(keys), LONGEST)
    same = (values[1:] == values[:-1]) & (tree[1:] == tree[:-1])[:, None]
    bits = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(keys), SKETCH_BITS // 8)
    return np.logical_and.accumulate(same, axis=1).sum(axis=1), SKETCH_BITS - _BITS[bits[1:] ^ bits[:-1]].sum(axis=1, dtype=np.int64)


def _forest(texts: DataFrame, trees: int) -> tuple[DataFrame, DataFrame]:
    """(u, v, lcp, agree): neighbours in the sorted trees with the longest prefix that they share in any;
    and (tid, tree, key): the strings that share ``SHORTEST`` values with a neighbour."""
    spark, width = texts.sparkSession, 2 * LONGEST
    at = F.sequence(F.lit(0), F.lit(trees - 1))
    entry = F.explode(F.transform(at, lambda i: F.struct(i.alias("tree"), F.substring("keys", i * width + 1, F.lit(width)).alias("key"))))
    entries = texts.where("shingles > 0").select("tid", "sketch", entry.alias("e")).select("e.tree", "e.key", "sketch", "tid")
    # by ranges of strings and texts, so that a node of any size is spread over tasks
    dealt = entries.repartitionByRange("tree", "key", "tid").sortWithinPartitions("tree", "key", "tid")
    ties = materialize(dealt.transform(arrow_map, _neighbours, ", ".join(f"{c} {k}" for c, k in _TIES.items())), "ngram-neighbours")
    # two rows for each task: neighbours that a boundary parts
    edges = ties.where("edge in (1, 2)").orderBy("part", "edge").collect()
    across, told = [], []
    for x, y in zip(edges[1::2], edges[2::2]):
        (lcp,), (agree,) = _alike(np.array([x.tree, y.tree]), [bytes(x.key), bytes(y.key)], [bytes(x.sketch), bytes(y.sketch)])
        if lcp >= SHORTEST and x.u != y.u:
            across.append((y.u, x.u, int(lcp), int(agree)))
            told += [(r.u, r.tree, bytearray(r.key)) for r in (x, y)]
    found = ties.where("edge = 0").select("u", "v", "lcp", "agree").unionByName(spark.createDataFrame(across, "u long, v long, lcp int, agree int"))
    pairs = found.groupBy(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).agg(F.max("lcp").alias("lcp"), F.max("agree").alias("agree"))
    below = ties.where("edge = 3").select(F.col("u").alias("tid"), "tree", "key").unionByName(spark.createDataFrame(told, "tid long, tree int, key binary"))
    return materialize(pairs, "ngram-ties"), below.dropDuplicates(["tid", "tree"])


def _blocks(shingles: Column, texts: Column) -> Column:
    return F.greatest(F.ceil(shingles / BLOCK_SHINGLES), F.ceil(texts / BLOCK_TEXTS)).cast("int")


def _candidates(texts: DataFrame, threshold: float, trees: int, recall: float) -> tuple[DataFrame, int]:
    """(tid, t1, t2, least, rows, groups): texts to compare and the groups that they are compared in, each a
    (group, tree, blocks); tree is -1 for a whole component; and the length of the prefixes."""
    ties, below = _forest(texts, trees)
    # equal bits are half by chance: agreement a is similarity 2a - 1
    seen = {2 * r["agree"] / SKETCH_BITS - 1: r["count"] for r in ties.groupBy("agree").count().collect()}  # at most 129 rows
    length = choose_length(seen, threshold, trees, recall)
    member = components(ties.where(F.col("lcp") >= length).select("u", "v"))
    known = texts.select("tid", "shingles").join(member.select(F.col("node").alias("tid"), F.col("label").alias("group")), "tid")
    known = materialize(known, "ngram-members")
    sizes = known.groupBy("group").agg(F.sum("shingles").alias("weight"), F.count("*").alias("size"))
    known = join_counted(known, sizes, ["group"], "size", known.count(), ["tid"])
    known = materialize(known.withColumn("blocks", _blocks(F.col("weight"), F.col("size"))).drop("weight", "size"), "ngram-components")
    whole = known.where("blocks = 1").select("tid", "group", F.lit(-1).alias("tree"), "blocks")
    node = F.xxhash64("tree", F.substring("key", 1, 2 * length)).alias("group")
    large = below.select("tid", "tree", node).join(known.where("blocks > 1").select("tid", "shingles"), "tid")
    large = materialize(large, "ngram-nodes")
    marks = [F.count("*").alias("size"), F.sum("shingles").alias("weight"), F.bit_xor(F.xxhash64("tid")).alias("mark"), F.sum("tid").alias("total")]
    nodes = large.groupBy("tree", "group").agg(*marks).where("size > 1")
    # of nodes with the same members that of the first tree
    nodes = nodes.groupBy("size", "mark", "total").agg(F.min(F.struct("tree", "group", "weight")).alias("n"))
    nodes = materialize(nodes.select("n.tree", "n.group", "size", _blocks(F.col("n.weight"), F.col("size")).alias("blocks")), "ngram-first")
    by_node = join_counted(large.drop("shingles"), nodes, ["tree", "group"], "size", nodes.agg(F.sum("size")).first()[0] or 0, ["tid"])
    groups = whole.unionByName(by_node.select("tid", "group", "tree", "blocks"))
    groups = groups.groupBy("tid").agg(F.collect_list(F.struct("group", "tree", "blocks")).alias("groups"))  # one, or at most one a tree
    return materialize(texts.select("tid", "t1", "t2", "least", "rows", "keys").join(groups, "tid"), "ngram-candidates"), length


def compare(shingle_sets: list[np.ndarray], threshold: float, first: int | None = None) -> np.ndarray:
    """Links of a list of shingle sets as a boolean matrix; with ``first``, only those between the first so many and the rest."""
    n = len(shingle_sets)
    sizes = np.array([len(s) for s in shingle_sets], dtype=np.int64)
    owner = np.repeat(np.arange(n), sizes)
    ids, column = np.unique(np.concatenate(shingle_sets), return_inverse=True)
    counts = np.bincount(column, minlength=len(ids))
    shared = np.zeros((n, n), np.float32)
    frequent = np.flatnonzero(counts > DENSE)
    place = np.full(len(ids), -1)
    place[frequent] = np.arange(len(frequent))
    for lo in range(0, len(frequent), 4096):
        here = (place[column] >= lo) & (place[column] < lo + 4096)
        block = np.zeros((n, min(4096, len(frequent) - lo)), np.float32)
        block[owner[here], place[column[here]] - lo] = 1
        shared += block @ block.T
    rare = np.flatnonzero((counts[column] > 1) & (counts[column] <= DENSE))
    rare = rare[np.argsort(column[rare], kind="stable")]
    col, own = column[rare], owner[rare]
    for d in range(1, DENSE):  # members of a column are neighbours: pair each with the d-th after it
        same = np.flatnonzero(col[d:] == col[:-d]) if len(col) > d else np.zeros(0, np.int64)
        if not len(same):
            break
        a, b = own[same], own[same + d]
        shared += np.bincount(np.minimum(a, b) * n + np.maximum(a, b), minlength=n * n).reshape(n, n)
    shared = np.triu(shared, 1).astype(np.float64)
    either = sizes[:, None] + sizes[None, :] - shared
    links = np.triu(shared / np.maximum(either, 1) >= threshold, 1)
    if first is not None:
        links[:first, :first] = False
        links[first:, first:] = False
    return links | links.T


def _first_tree(links: np.ndarray, prefixes: list[bytes], trees: int, tree: int) -> np.ndarray:
    """Of the links those whose texts share no node of a tree before ``tree``."""
    strings_ = np.array([np.frombuffer(p, np.uint8) for p in prefixes]).reshape(len(prefixes), trees, -1)
    a, b = np.nonzero(links)
    for t in range(tree):
        _, node = np.unique(strings_[:, t], axis=0, return_inverse=True)
        apart = node.ravel()[a] != node.ravel()[b]
        a, b = a[apart], b[apart]
    out = np.zeros_like(links)
    out[a, b] = True
    return out


def _verify(threshold: float, trees: int):
    """Rows come by group: (group, tree, a, b, block, tid, rows, set, prefixes). Out: (tid, other, texts, docs): link counts and spanning edges."""

    def close(rows: list[tuple], tree: int, a: int, b: int) -> Iterator[tuple]:
        members = {}
        for block, tid, *more in rows:
            members.setdefault(tid, (block, *more))
        order = sorted(members, key=lambda t: (members[t][0] != a, t))
        if len(order) < 2:
            return
        sets = [np.frombuffer(members[t][2], np.uint64) for t in order]
        links = compare(sets, threshold, None if a == b else sum(members[t][0] == a for t in order))
        counted = links if tree < 0 else _first_tree(links, [members[t][3] for t in order], trees, tree)
        weights = np.array([members[t][1] for t in order], dtype=np.int64)
        texts, docs = counted.sum(axis=1), counted @ weights
        for i in np.flatnonzero(texts):
            yield order[i], None, int(texts[i]), int(docs[i])
        linked, seen = links.any(axis=1), np.zeros(len(order), bool)
        for i in range(len(order)):  # a tree over each linked part
            if seen[i] or not linked[i]:
                continue
            seen[i], wave = True, [i]
            while wave:
                x = wave.pop()
                new = np.flatnonzero(links[x] & ~seen)
                seen[new] = True
                wave += new.tolist()
                yield from ((order[y], order[i], 0, 0) for y in new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, [], []

        def page() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            return pa.record_batch([pa.array(list(c), pa.int64()) for c in columns], names=["tid", "other", "texts", "docs"])

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(9)], strict=True):
                if row[:4] != at:
                    if at is not None:
                        out += close(held, *at[1:])
                    at, held = row[:4], []
                held.append(row[4:])
            if len(out) > 20_000:
                yield page()
                out = []
        if at is not None:
            out += close(held, *at[1:])
        yield page()

    return run


def _links(docs: DataFrame, texts: DataFrame, n: int, threshold: float, trees: int, recall: float) -> DataFrame:
    """(tid, other, texts, docs) of the exact comparison of all candidates."""
    known, length = _candidates(texts, threshold, trees, recall)
    group = "struct<group:bigint,tree:int,blocks:int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(t.as_py(), n)).tobytes() for t in batch.column(4)]
            cut = [np.frombuffer(k.as_py(), np.uint8).reshape(trees, -1)[:, : 2 * length].tobytes() for k in batch.column(3)]
            yield pa.record_batch([*(batch.column(i) for i in range(3)), pa.array(cut, pa.binary()), pa.array(sets, pa.binary())], names=["tid", "rows", "groups", "prefixes", "set"])

    # one row stands for all copies of a text: with its id in the key, copies of a common text are spread. Always by a
    # sort-merge join: candidates grow with the input, and what holds at one size holds at all
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("t1").alias("x1"), F.col("t2").alias("x2"), F.encode(body(), "UTF-8").alias("text"))
    chosen = rows.join(known.hint("merge"), (F.col("x1") == F.col("t1")) & (F.col("x2") == F.col("t2")) & F.col("id").eqNullSafe(F.col("least")))
    sets = chosen.select("tid", "rows", "groups", "keys", "text").transform(arrow_map, run, f"tid long, rows long, groups array<{group}>, prefixes binary, set binary")
    each = sets.withColumn("g", F.explode("groups")).select("tid", "rows", "set", F.when(F.col("g.tree") >= 0, F.col("prefixes")).alias("prefixes"), "g.*")
    own = F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int")
    dealt = each.withColumn("block", own).withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["group", "tree", "a", "b"]
    dealt = dealt.select("group", "tree", F.least("block", "_x").alias("a"), F.greatest("block", "_x").alias("b"), "block", "tid", "rows", "set", "prefixes")
    grouped = dealt.repartition(*key).sortWithinPartitions(*key)
    return materialize(grouped.transform(arrow_map, _verify(threshold, trees), "tid long, other long, texts long, docs long"), "ngram-links")


def _classes(docs: DataFrame, n: int, threshold: float, trees: int, recall: float) -> DataFrame:
    """Per different text: t1, t2, least, rows, label (of its class), class_id, texts and docs that it links to."""
    texts = _texts(docs, n, trees)
    links = _links(docs, texts, n, threshold, trees, recall)
    counts = links.where("other is null").groupBy("tid").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    label = components(links.where("other is not null").select(F.col("tid").alias("u"), F.col("other").alias("v")))
    joined = counts.join(label.withColumnRenamed("node", "tid"), "tid")
    linked = materialize(texts.select("tid", "least").join(joined, "tid"), "ngram-linked")
    ids = linked.groupBy("label").agg(F.min("least").alias("class_id"), F.count("*").alias("size"))
    linked = join_counted(linked.drop("least"), ids, ["label"], "size", linked.count(), ["tid"]).drop("size")
    made = texts.select("tid", "t1", "t2", "least", "rows").join(linked, "tid", "left")
    return materialize(
        made.select("t1", "t2", "least", "rows", F.coalesce("label", "tid").alias("label"), F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("docs", F.lit(0)).alias("docs")), "ngram-classes"
    )


def ngram_groups(df: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_text_links.

    Two texts are linked if the Jaccard similarity of their sets of word n-grams (words between ASCII white space; a
    shorter text is one gram) is at least ``threshold``; equal texts always are. A class is a connected part, class_id its
    least doc_id (null if none has one). n_links counts the other documents linked to this one, n_text_links the different
    texts. Null text counts as empty; an empty text is linked to empty ones alone; texts of any length are taken whole.
    Repeated rows count as copies. An empty table gives no rows; other columns play no part.
    """
    docs = _keyed(df.select("doc_id", "text"))
    classes = _classes(docs, n, threshold, trees, recall)
    total = classes.agg(F.sum("rows")).first()[0] or 0
    found = join_counted(docs.select("doc_id", "t1", "t2"), classes.drop("least", "label"), ["t1", "t2"], "rows", total, ["doc_id"])
    return found.select("doc_id", "class_id", (F.col("rows") - 1 + F.col("docs")).alias("n_links"), F.col("texts").alias("n_text_links"))


def drop_near_copies(df: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """The rows of ``df`` that stay, with its columns: of each class, as ``ngram_groups`` has them, that with the least doc_id.

    A class without ids keeps one of its rows, and so does an id that repeated rows of a text share. An empty table
    gives no rows; other columns may have any names.
    """
    docs = _keyed(df.select(F.struct("*").alias("_row"), "doc_id", "text"))
    classes = _classes(docs, n, threshold, trees, recall)
    # one text for each class: among those with its id, any
    best = classes.where(F.col("least").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min(F.struct("t1", "t2")).alias("best"), F.min("class_id").alias("keep"))
    best = materialize(best.select(F.col("best.t1").alias("x1"), F.col("best.t2").alias("x2"), "keep"), "ngram-kept")
    kept = docs.join(best, (F.col("t1") == F.col("x1")) & (F.col("t2") == F.col("x2")) & F.col("doc_id").eqNullSafe(F.col("keep")))
    if not kept.groupBy("t1", "t2").count().where("count > 1").isEmpty():  # repeated rows
        kept = kept.dropDuplicates(["t1", "t2"])
    return kept.select("_row.*")
