"""Near-duplicate join on word shingles by chosen paths.

1. Rows go by a key, the hash of id and text. Texts with the same shingle set are one set, represented by the smallest key;
   sets keep a bottom-k sketch.
2. Recursion: a node of the search tree draws shared tokens by a hash of (node, token), about 1/threshold of them for
   each set, and a set goes to the child of every token of its sketch that was drawn. Nodes with few sets are leaves;
   larger ones are split again, `depth` times at most. Several independent runs reach the target recall.
3. Leaves with the same sets are one leaf. Each is compared by brute force on the whole sets, large ones in blocks; a
   pair that meets in several leaves counts in the first one alone. Out of a leaf come link counts and a spanning
   forest of the links, never the pairs.
4. Links between sets make classes by star contraction; copies join the class of their set.

Result: a row for each document with class_id (smallest id of its class), n_links (other documents whose similarity is at
least the threshold) and n_copies (documents with the same shingle set, itself included).

Defined cases: a text without words, or null, is a class of its own, without links; one with fewer words than a shingle
has one shingle of all of them; rows without id are left out; repeated rows are copies; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlight.llm.shared import row_key, written
from barlight.llm.shingles import U, grams, mix, words
from barlight.llm.url_filter import may_have
from barlight.sources.scratch import cleared, delete

SMALL = 128  # sets in a leaf
BLOCK = 512  # sets in a block of a leaf that could not be split further


def token_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(grams(words(text)[0], width)) if text else np.zeros(0, U)


def signature(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def runs_for(recall: float, chance: float = 0.4) -> int:
    """Independent runs after which a pair that one run finds with this chance is missed with 1 - recall at most."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - chance)))


def sketches(given: DataFrame, width: int, k: int) -> DataFrame:
    """given: key, doc_id, text. Rows of key, doc_id, sig (null without words), n_tokens, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, sizes, kept = [], [], []
            for text in batch.column("text"):
                tokens = token_set(text.as_py(), width)
                sizes.append(len(tokens))
                sigs.append(signature(tokens) if len(tokens) else None)
                turned = mix(tokens)
                low = turned if len(turned) <= k else np.partition(turned, k - 1)[:k]
                kept.append(np.sort(low).tobytes())
            columns = [batch.column("key"), batch.column("doc_id"), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int32()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "sig", "n_tokens", "sketch"])

    return given.mapInArrow(run, "key long, doc_id long, sig binary, n_tokens int, sketch binary")


def children(members: DataFrame, threshold: float, runs: int) -> DataFrame:
    """members: rep, sketch, node (null: the root of every run). Rows of rep and each child node it goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, nodes = [], []
            for rep, sketch, node in zip(batch.column("rep").to_pylist(), batch.column("sketch").to_pylist(), batch.column("node").to_pylist()):
                tokens = np.frombuffer(sketch, U)
                limit = U(min(2**64 - 1, int(2**64 / (threshold * max(1, len(tokens))))))
                for start in range(1, runs + 1) if node is None else [node & (2**64 - 1)]:
                    drawn = mix(tokens ^ mix(np.array([start], U)))
                    chosen = mix(drawn[drawn <= limit])
                    reps.append(np.full(len(chosen), rep))
                    nodes.append(chosen)
            empty = np.zeros(0, np.int64)
            columns = [pa.array(np.concatenate([empty, *reps])), pa.array(np.concatenate([empty.astype(U), *nodes]).astype(U).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["rep", "node"])

    return members.select("rep", "sketch", "node").mapInArrow(run, "rep long, node long")


def leaves(sets: DataFrame, threshold: float, runs: int, depth: int) -> DataFrame:
    """rep, node, n (sets in the leaf): leaves of two sets and more, one for each different collection of sets."""
    members = written(children(sets.withColumn("node", F.lit(None).cast("long")), threshold, runs), "paths")
    found = None
    for level in range(1, depth + 1):
        sizes = members.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("s")).where("n > 1")
        sizes = written(sizes, "nodes")
        last = level == depth
        done = (sizes if last else sizes.where(F.col("n") <= SMALL)).groupBy("n", "x", "s").agg(F.min("node").alias("node")).select("node", "n", "x", "s")
        part = members.join(done, "node")
        found = part if found is None else found.unionByName(part)
        wide = sizes.where(F.col("n") > SMALL).select("node")
        if last or wide.isEmpty():
            break
        members = written(children(members.join(wide, "node").join(sets, "rep"), threshold, runs), "paths")
    # The same collection can be a leaf on several levels.
    once = found.select("node", "n", "x", "s").distinct().groupBy("n", "x", "s").agg(F.min("node").alias("node"))
    return found.select("rep", "node", "n").join(once.select("node"), "node", "left_semi").distinct()


def compare(sets: list[np.ndarray], sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold (a square matrix, its diagonal false)."""
    m = len(sets)
    if m <= 6:
        out = np.zeros((m, m), bool)
        for i in range(m):
            for j in range(i):
                if min(sizes[i], sizes[j]) >= threshold * max(sizes[i], sizes[j]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    out[i, j] = out[j, i] = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
        return out
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    head = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    column = np.cumsum(head) - 1
    shared = np.bincount(column)[column] > 1  # tokens of one set alone meet no other
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    both = np.zeros((m, m), np.float32)
    width = 4096
    for at in range(0, int(column.max(initial=-1)) + 1, width):
        a, b = np.searchsorted(column, [at, at + width])
        grid = np.zeros((m, width), np.float32)
        grid[owner[a:b], column[a:b] - at] = 1
        both += grid @ grid.T
    out = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-6
    np.fill_diagonal(out, False)
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the components of a link matrix."""
    m, seen, edges = len(linked), np.zeros(len(linked), bool), []
    for root in range(m):
        if seen[root] or not linked[root].any():
            continue
        seen[root], front = True, [root]
        while front:
            i = front.pop()
            new = np.flatnonzero(linked[i] & ~seen)
            seen[new] = True
            edges += [(i, int(j)) for j in new]
            front += new.tolist()
    return edges


def brute_force(rows: DataFrame, threshold: float, width: int) -> DataFrame:
    """rows: node, bi, bj, block, rep, copies, nodes, tokens. Returns rep, links, other (an edge of the forest, or null)."""

    def judge(node: int, bi: int, bj: int, group: list[tuple]) -> Iterator[tuple[int, int, int | None]]:
        group = list({g[1]: g for g in group}.values())
        sets = [np.frombuffer(g[4], U) for g in group]
        sizes, copies, block = np.array([len(s) for s in sets]), np.array([g[2] for g in group]), np.array([g[0] for g in group])
        linked = compare(sets, sizes, threshold)
        if bi != bj:
            linked &= block[:, None] != block[None, :]
        if not linked.any():
            return
        # A pair counts in the first leaf that both are in.
        early = [{x for x in g[3] if x < node} for g in group]
        counted = linked.copy()
        names = {x: i for i, x in enumerate(sorted(set().union(*early)))}
        if names:
            grid = np.zeros((len(group), len(names)), np.float32)
            for i, e in enumerate(early):
                grid[i, [names[x] for x in e]] = 1
            counted &= (grid @ grid.T) == 0
        links = counted @ copies
        for i in np.flatnonzero(links):
            yield group[i][1], int(links[i]), None
        for i, j in forest(linked):
            yield group[i][1], 0, group[j][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(x, pa.int64()) for x in (zip(*out) if out else [[], [], []])]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["rep", "links", "other"])

        for batch in batches:
            lists = [batch.column(c).to_pylist() for c in ("node", "bi", "bj", "block", "rep", "copies", "nodes", "tokens")]
            for node, bi, bj, *member in zip(*lists):
                if (node, bi, bj) != key:
                    if key:
                        out.extend(judge(*key, group))
                    key, group = (node, bi, bj), []
                group.append(tuple(member))
            yield flush()
        if key:
            out.extend(judge(*key, group))
        yield flush()

    return rows.mapInArrow(run, "rep long, links long, other long")


def with_least(rows: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """rows with m, the least of their a; least: a, m, n (rows of a). Nodes with many edges are few and are broadcast, so that no task gets all edges of one."""
    many = max(100, n_edges // 50_000)
    hubs = F.broadcast(least.where(F.col("n") > many).select("a", "m"))  # at most 100,000 rows: the n of all nodes are twice the edges
    marked = rows.join(hubs, "a", "left")
    rest = marked.where("m is null").drop("m").join(least.where(F.col("n") <= many).select("a", "m"), "a")
    return marked.where("m is not null").select(*rest.columns).unionByName(rest)


def classes(edges: DataFrame) -> DataFrame:
    """edges: a, b. Rows of rep and class_id (smallest of its component) by alternating star contraction."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    state = mark(edges)
    spark = edges.sparkSession
    while state.n:
        last = edges.scratch_path_
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = with_least(both.where("b > a"), least, state.n).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = with_least(large, least, state.n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = written(small.where("a <> b").distinct(), "edges")
        before, state = state, mark(edges)
        delete(spark, last)
        if state == before:
            break
    return edges.select(F.col("a").alias("rep"), F.col("b").alias("class_id"))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """key, doc_id, text of each row."""
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", "text")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, recall: float = 0.999, depth: int = 3, sketch: int = 64, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, n_links, n_copies."""
    given = keyed(docs, doc_id, text).where(F.col("doc_id").isNotNull())
    with cleared(docs.sparkSession) as keep:
        base, of_set = linked(given, width, threshold, recall, depth, sketch)
        out = base.select("doc_id", "sig").join(of_set, "sig", "left")
        return keep(written(out.select("doc_id", F.coalesce("first.doc_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies")), "classes"))


def linked(given: DataFrame, width: int, threshold: float, recall: float, depth: int, sketch: int) -> tuple[DataFrame, DataFrame]:
    """given: key, doc_id, text. The sketches, and for each set: sig, first (of its class: the row with the smallest id, those without last), n_links, n_copies."""
    base = written(sketches(given, width, sketch), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    sets = base.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.min("key").alias("rep"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"), F.min(order).alias("first"))
    sets = written(sets, "sets")
    with cleared(given.sparkSession) as keep:
        found = keep(written(leaves(sets.select("rep", "sketch"), threshold, runs_for(recall), depth), "leaves"))
    lists = found.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("leaves"))
    near = written(lists.join(sets.select("rep", "sig", "copies"), "rep").withColumnRenamed("rep", "key"), "near")
    texts = may_have(given.select("key", "text"), "key", near, "key").where("maybe").select("row.*").dropDuplicates(["key"])  # repeats of a row
    rows = texts.join(near, "key")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [token_set(t.as_py(), width) for t in batch.column("text")]
            same = pa.array([signature(m) == s.as_py() for m, s in zip(made, batch.column("sig"))], pa.bool_())
            columns = [batch.column("key"), batch.column("copies"), batch.column("leaves"), pa.array([m.tobytes() for m in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["rep", "copies", "leaves", "tokens"]).filter(same)

    kind = "array<struct<node:long,n:long>>"
    wide = rows.select("key", "text", "sig", "copies", F.col("leaves").cast(kind).alias("leaves")).mapInArrow(tokens, f"rep long, copies long, leaves {kind}, tokens binary")
    blocks = F.ceil(F.col("leaf.n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    placed = (
        wide.withColumn("nodes", F.col("leaves.node"))
        .withColumn("leaf", F.explode("leaves"))
        .select("rep", "copies", "nodes", "tokens", F.col("leaf.node").alias("node"), blocks.alias("blocks"), own.alias("block"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.col("node"), F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "rep", "copies", "nodes", "tokens")
    )
    dealt = placed.repartition("node", "bi", "bj").sortWithinPartitions("node", "bi", "bj")
    links = written(brute_force(dealt, threshold, width), "links")
    groups = classes(links.where(F.col("other").isNotNull()).select(F.col("rep").alias("a"), F.col("other").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    reps = sets.select("sig", "rep", "copies", "first").join(counts, "rep", "left").join(groups, "rep", "left").withColumn("class_id", F.coalesce("class_id", "rep"))
    firsts = reps.groupBy("class_id").agg(F.min("first").alias("first"))
    return base, reps.drop("first").join(firsts, "class_id").select("sig", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))


def _touched(base: DataFrame, of_set: DataFrame) -> DataFrame:
    """key, gone of the keys whose rows all go, or of which one stays."""
    judged = base.select("key", "sig").join(of_set.select("sig", F.col("first.key").alias("first")), "sig", "left")
    # Of the rows with these keys, those of a class that another row stands for go and repeats are reduced to one.
    marked_keys = judged.groupBy("key").agg(F.max(F.coalesce(F.col("first") != F.col("key"), F.lit(False))).alias("gone"), F.count("*").alias("n"))
    return written(marked_keys.where("gone or n > 1").select("key", "gone"), "dropped")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8, recall: float = 0.999, depth: int = 3, sketch: int = 64) -> DataFrame:
    """One row of each class: the one with the smallest id, or, if none has an id, any one. Of repeated rows one stays, rows without words too."""
    with cleared(docs.sparkSession) as keep:
        touched = keep(_touched(*linked(keyed(docs, doc_id, text), width, threshold, recall, depth, sketch)))
    packed = docs.select(row_key(F.col(doc_id).cast("long"), F.col(text).cast("string")).alias("key"), F.struct(*docs.columns).alias("row"))
    marked = may_have(packed, "key", touched, "key").select("key", "maybe", F.col("row.row").alias("row"))
    checked = marked.where("maybe").join(touched.where("gone").select("key"), "key", "left_anti")
    repeated = may_have(checked.select("key", "row"), "key", touched.where("not gone"), "key").select("key", "maybe", F.col("row.row").alias("row"))
    once = repeated.where("maybe").dropDuplicates(["key"])
    return marked.where("not maybe").select("row.*").unionByName(repeated.where("not maybe").select("row.*")).unionByName(once.select("row.*"))
