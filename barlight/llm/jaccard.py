"""N-gram Jaccard join with prefix trees.

A document is the set of its distinct shingles (64-bit hashes). Two documents link if their sets' intersection is at least 80 % of
their union, so a document more than a fifth of whose shingles occur nowhere else links with nothing.

1. Blocks ask which of their shingles occur in another document; for a half of the hash space this settles most documents.
2. Equal sets become one class, represented by its smallest doc_id.
3. Shingles of the representatives are ordered by frequency, globally. Of two linked sets the larger has a common shingle among its
   rarest fifth and one, the smaller even among its rarest ninth and one. Representatives that share a shingle in this way are joined to
   groups; each group has all links of its members.
4. In a group the sets, most frequent shingles first, are put into a prefix tree one after the other. A set walks the tree
   once for all sets it holds: the overlap with a shared prefix is counted once, a subtree is left when overlap so far and what can still be
   shared don't reach the threshold, or when all its sets are known to be in the walker's component.
5. A group too large for a task is dealt out in parts, each with the group's first set. Sets that didn't get into its
   component then meet the sets with which they share a cell: one of those rare shingles, and a band of sizes. Small cells are put
   together to tasks; a large cell is cut in blocks that meet in twos. No task holds more than a few times GROUP_SETS sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlight.llm import blocks as B
from barlight.llm.common import Words, mixed, rolled, text_bytes
from barlight.llm.components import components
from barlight.session import staged

BLOCK_BYTES = 2_000_000
GROUP_SETS = 1000  # representatives in one part of a group or one block of a cell
BAND = 1.3  # ratio of sizes in a band; more than that of linked sets, 1.25, so these are at most one band apart
PERCENT = 80

# Linked: 100 i >= 80 (a + b - i), that is 9 i >= 4 (a + b) for intersection i of sets of a and b.


class Sets:
    """Distinct shingle hashes of a block's texts, sorted within each document."""

    def __init__(self, texts: pa.Array, width: int):
        w = Words(*text_bytes(texts), fold_case=True)
        self.docs = len(w.count)
        h = w.hashes()
        grams = mixed(rolled(h, width))
        whole = w.whole(width)
        doc, value = w.doc[whole], grams[whole]
        # With fewer words the whole sequence is the one shingle, told apart by its number of words.
        for size in range(1, width):
            first = (w.last - w.count)[w.count == size]
            if len(first):
                value = np.append(value, mixed(rolled(h, size)[first] + np.uint64(size)))
                doc = np.append(doc, w.doc[first])
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])) if len(doc) else np.zeros(0, bool)
        self.doc, self.value = doc[new], value[new]
        self.size = np.bincount(self.doc, minlength=self.docs).astype(np.int64)

    def asked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Half of the shingles: their places, the distinct ones, to which each belongs, which are in several documents here."""
        half = np.flatnonzero(self.value & np.uint64(1))
        distinct, owner, count = np.unique(self.value[half], return_inverse=True, return_counts=True)
        return half, distinct, owner, count > 1

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit sums over each set."""
        out = []
        for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
            sums = np.zeros(self.docs, np.uint64)
            np.add.at(sums, self.doc, mixed(self.value ^ np.uint64(salt)))
            out.append(sums.view(np.int64))
        return out[0], out[1]


ROWS = "block bigint, row int, doc_id bigint, n_shingles bigint, open boolean, key1 bigint, key2 bigint, tokens binary"


def _rows(blocks: DataFrame, width: int) -> DataFrame:
    """A row for each document; open: it may link. tokens: sorted hashes that may occur elsewhere."""
    buckets = B.bucket_count(blocks)

    def ask(block, batch, _) -> Iterator[pa.RecordBatch]:
        _, distinct, _, repeated = Sets(batch.column(batch.schema.get_field_index("text")), width).asked()
        return B.hash_messages(block, distinct, repeated, buckets, drop_bits=16)

    def settle(block, batch, answers) -> Iterator[pa.RecordBatch]:
        sets = Sets(batch.column(batch.schema.get_field_index("text")), width)
        half, distinct, owner, _ = sets.asked()
        lonely = np.zeros(len(sets.value), bool)
        lonely[half] = (B.gathered(answers[0], len(distinct))[owner] & 1) == 0
        alone = np.bincount(sets.doc[lonely], minlength=sets.docs)
        ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
        is_open = (100 * alone <= (100 - PERCENT) * sets.size) & (sets.size > 0) & np.asarray(ids.is_valid())
        kept = is_open[sets.doc] & ~lonely
        raw, ends = sets.value[kept].tobytes(), np.append(0, np.cumsum(np.bincount(sets.doc[kept], minlength=sets.docs))).tolist()
        tokens = [raw[8 * a : 8 * b] if o else None for a, b, o in zip(ends, ends[1:], is_open.tolist(), strict=False)]
        key1, key2 = sets.keys()
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), ids, pa.array(sets.size), pa.array(is_open), pa.array(key1), pa.array(key2), pa.array(tokens, pa.binary())], names=["block", "row", "doc_id", "n_shingles", "open", "key1", "key2", "tokens"])

    answers = B.asked(blocks, ask, B.met_elsewhere)
    return staged(B.each_block(B.with_answers(blocks, answers), settle, ROWS))


def _frequency(data: list[bytes]) -> list[bytes]:
    """Logarithm (base 2, rounded up) of the number of sets that hold each token: 0 if one does."""
    parts = [B.unsqueezed(d, np.uint64, np.uint8) for d in data]
    tokens = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in parts])
    _, group = np.unique(tokens, return_inverse=True)
    total = np.bincount(group, weights=np.concatenate([x[1] for x in parts]))
    return B.split_answer(np.minimum(15, np.ceil(np.log2(np.maximum(total, 1)))).astype(np.uint8)[group], [len(x[0]) for x in parts])


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    off, raw = text_bytes(batch.column(batch.schema.get_field_index("tokens")))
    return off // 8, np.ascontiguousarray(raw).view(np.uint64)


def _ranked(reps: DataFrame) -> DataFrame:
    """id, n, tokens in the global order (rarest first, those of one set only left out) and how many of them make the prefix.

    prefix is that towards sets as large or smaller, short_prefix that towards sets as large or larger: a ninth and one, as
    9 i >= 4 (a + b) >= 8 a for the smaller size a.
    """
    blocks = B.packed(reps, BLOCK_BYTES, "tokens")
    buckets = B.bucket_count(blocks)

    def ask(block, batch, _) -> Iterator[pa.RecordBatch]:
        distinct, count = np.unique(_tokens(batch)[1], return_counts=True)
        return B.hash_messages(block, distinct, np.minimum(count, 255), buckets)

    def rank(block, batch, answers) -> Iterator[pa.RecordBatch]:
        off, tokens = _tokens(batch)
        distinct, owner = np.unique(tokens, return_inverse=True)
        level = B.gathered(answers[0], len(distinct))[owner].astype(np.uint64)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
        keys = (level << np.uint64(60)) | (tokens >> np.uint64(4))
        order = np.lexsort((keys, doc))
        shared = level[order] > 0
        keys, doc = keys[order][shared], doc[order][shared]
        n = batch.column(batch.schema.get_field_index("n")).to_numpy()
        count = np.bincount(doc, minlength=len(n))
        ends = np.append(0, np.cumsum(count)).tolist()
        prefix = n - (PERCENT * n + 99) // 100 + 1 - (n - count)
        short = n - (8 * n + 8) // 9 + 1 - (n - count)
        raw = keys.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), pa.array(n), pa.array(np.clip(prefix, 0, count)), pa.array(np.clip(short, 0, count)), pa.array([raw[8 * a : 8 * b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())], names=["id", "n", "prefix", "short_prefix", "tokens"])

    answers = B.asked(blocks, ask, _frequency)
    ranked = B.each_block(B.with_answers(blocks, answers), rank, "id bigint, n bigint, prefix bigint, short_prefix bigint, tokens binary")
    return staged(ranked.filter("prefix > 0"))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        off, tokens = _tokens(batch)
        prefix, short = (batch.column(i).to_numpy() for i in (1, 2))
        row = np.repeat(np.arange(len(prefix)), prefix)
        place = np.arange(len(row)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(tokens[off[:-1][row] + place].view(np.int64)), pa.array(place < short[row])], names=["id", "token", "short"])


class _Node:
    __slots__ = ("children", "low", "high", "one", "run", "same", "sets", "tail")

    def __init__(self, run: np.ndarray):
        self.run = run  # tokens on the way to this node
        self.children: dict[int, _Node] = {}
        self.sets: list[int] = []  # sets that end here
        self.tail = 0  # most tokens that a set below has after this node
        self.low, self.high = 1 << 62, 0  # sizes of the sets at and below this node
        self.one, self.same = -1, True  # a set below; whether all were of its component when they came


class PrefixTree:
    """Sets of one group, in the order they came; unions linked ones."""

    def __init__(self, ids: list[int]):
        self.root = _Node(np.zeros(0, np.uint64))
        self.ids, self.parent = ids, list(range(len(ids)))
        self.n: dict[int, int] = {}

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:  # the smaller id is the root
            i, j = (i, j) if self.ids[i] < self.ids[j] else (j, i)
            self.parent[j] = i

    def link(self, x: int, tokens: np.ndarray, n: int) -> None:
        """Union x with all sets of the tree that it links with."""
        mine, total = self.find(x), len(tokens)
        stack = [(self.root, 0, 0)]
        while stack:
            node, overlap, at = stack.pop()
            if node.one < 0 or 100 * node.high < PERCENT * n or PERCENT * node.low > 100 * n:
                continue
            if node.same and self.find(node.one) == mine:
                continue
            run = node.run
            if len(run):
                place = np.searchsorted(tokens[at:], run) + at
                inside = place < total
                overlap += int((tokens[place[inside]] == run[inside]).sum())
                at = int(np.searchsorted(tokens, run[-1], side="right"))
            low = max(node.low, -(-PERCENT * n // 100))
            if 9 * (overlap + min(total - at, node.tail)) < 4 * (n + low):
                continue
            for y in node.sets:
                if 9 * overlap >= 4 * (n + self.n[y]):
                    self.union(x, y)
                    mine = self.find(x)
            following = int(tokens[at]) if at < total else -1
            stack += [(child, overlap, at) for first, child in node.children.items() if first != following]
            if following in node.children:  # the likeliest way is walked first
                stack.append((node.children[following], overlap, at))

    def add(self, x: int, tokens: np.ndarray, n: int) -> None:
        node, at = self.root, 0
        self.n[x] = n
        while True:
            if node.one < 0:
                node.one = x
            elif node.same and self.find(node.one) != self.find(x):
                node.same = False
            node.low, node.high, node.tail = min(node.low, n), max(node.high, n), max(node.tail, len(tokens) - at)
            if at == len(tokens):
                node.sets.append(x)
                return
            first = int(tokens[at])
            child = node.children.get(first)
            if child is None:
                child = node.children[first] = _Node(tokens[at:])
            else:
                size = min(len(child.run), len(tokens) - at)
                differs = child.run[:size] != tokens[at : at + size]
                common = int(differs.argmax()) if differs.any() else size
                if common < len(child.run):  # part the way in two
                    upper = _Node(child.run[:common])
                    upper.low, upper.high, upper.one, upper.same = child.low, child.high, child.one, child.same
                    upper.tail = child.tail + len(child.run) - common
                    child.run = child.run[common:]
                    upper.children[int(child.run[0])] = child
                    node.children[first] = child = upper
            at += len(child.run)
            node = child


LINKS = "id bigint, root bigint"


def _joined(group: pa.Table) -> pa.Table:
    """Components within one part of a group: id and root of each of its sets.

    `seen` is a component known before. In round two sets outside the group's first component (visitor) are put in last; sets
    of one component aren't compared.
    """
    rows = group.select(["id", "n", "seen", "visitor", "tokens"]).to_pylist()
    rows.sort(key=lambda r: (r["visitor"], r["n"], r["id"]))
    tree = PrefixTree([r["id"] for r in rows])
    heads: dict[int, int] = {}
    for x, r in enumerate(rows):
        if r["seen"] is not None:
            tree.union(heads.setdefault(r["seen"], x), x)
    for x, r in enumerate(rows):
        tokens = np.frombuffer(r["tokens"], np.uint64)[::-1]  # most frequent first
        # Descending keys become ascending ones, as the searches want them.
        tokens = ~tokens
        # In round two only visitors look for links; the others are in one component.
        if r["seen"] is None or r["visitor"]:
            tree.link(x, tokens, r["n"])
        tree.add(x, tokens, r["n"])
    return pa.table([pa.array([r["id"] for r in rows], pa.int64()), pa.array([rows[tree.find(x)]["id"] for x in range(len(rows))], pa.int64())], names=["id", "root"])


def _met(prefixes: DataFrame, split: DataFrame) -> DataFrame:
    """task, id: which sets of `split` (grp, id, n, seen) meet in round two. Only ids move.

    A cell is a token and a band of sizes. A set is in the cells of its prefix and its band; those of its short prefix may also be
    the smaller partner of a set one band higher. Only pairs with such a set (short) and with a set outside
    the group's first component (outside) can bring anything; cells without one, or of one component, go.
    """
    band = F.floor(F.log("n") / F.log(F.lit(BAND)))
    rows = prefixes.join(split.select("grp", "id", "seen", band.alias("own")), "id")
    rows = rows.withColumn("band", F.explode(F.when(F.col("short"), F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))
    rows = staged(rows.select("grp", "token", "band", "id", "seen", "short", (F.col("seen") != F.col("grp")).alias("outside")))
    cells = rows.groupBy("grp", "token", "band").agg(F.count("*").alias("sets"), F.min("seen").alias("least"), F.max("seen").alias("most"), F.max("short").alias("joins"), F.sum(F.xxhash64("id", "short").cast("decimal(38,0)")).alias("who"))
    cells = cells.filter("joins AND least <> most")
    # Tokens that the same sets hold make one cell.
    cells = cells.groupBy("grp", "band", "sets", "who").agg(F.min("token").alias("token"))
    rows = staged(rows.join(cells.select("grp", "token", "band", "sets"), ["grp", "token", "band"]))
    few = rows.filter(F.col("sets") <= GROUP_SETS)
    bins = few.groupBy("grp").agg(F.ceil(F.count("*") / GROUP_SETS).alias("bins"))
    few = few.join(bins, "grp").select(F.struct("grp", F.pmod(F.xxhash64("token", "band"), "bins").alias("bin")).alias("task"), "id").distinct()
    few = few.select(F.to_json("task").alias("task"), "id")
    many = rows.filter(F.col("sets") > GROUP_SETS)
    cell = ["token", "band"]
    blocks = many.groupBy(*cell, "short", "outside").agg(F.ceil(F.count("*") / GROUP_SETS).alias("blocks"))
    many = many.join(blocks, [*cell, "short", "outside"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("blocks")))
    blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    block = F.struct("short", "outside", "salt")
    x, y = (blocks.select(*cell, block.alias(name)) for name in ("x", "y"))
    pairs = x.join(y, cell).filter("x <= y AND (x.short OR y.short) AND (x.outside OR y.outside)")
    pairs = pairs.select(*cell, F.to_json(F.struct(*cell, "x", "y")).alias("task"), F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    many = many.select(*cell, block.alias("block"), "id").join(pairs, [*cell, "block"]).select("task", "id")
    return few.unionByName(many)


def _links(ranked: DataFrame) -> DataFrame:
    """id, root of all representatives that link with another, as edges."""
    prefixes = ranked.select("id", "prefix", "short_prefix", "tokens").mapInArrow(_prefixes, "id bigint, token bigint, short boolean")
    prefixes = staged(prefixes)
    least = prefixes.groupBy("token").agg(F.min(F.when(F.col("short"), F.col("id"))).alias("first"), F.count("*").alias("sets")).filter("sets > 1 AND first IS NOT NULL").drop("sets")
    groups = components(prefixes.join(least, "token").select(F.col("id").alias("a"), F.col("first").alias("b")))
    groups = staged(groups.withColumnRenamed("root", "grp"))
    sizes = groups.groupBy("grp").agg(F.count("*").alias("sets")).withColumn("parts", F.ceil(F.col("sets") / GROUP_SETS)).drop("sets")
    members = ranked.select("id", "n", "tokens").join(groups, "id").join(sizes, "grp")
    members = staged(members.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))))
    nothing = (F.lit(None).cast("long").alias("seen"), F.lit(False).alias("visitor"))
    one = members.filter("parts = 1 OR id <> grp").select("grp", "part", "id", "n", "tokens", *nothing)
    # The group's first set is in every part.
    first = members.filter("parts > 1 AND id = grp").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    one = one.unionByName(first.select("grp", "part", "id", "n", "tokens", *nothing))
    links = staged(one.groupBy("grp", "part").applyInArrow(_joined, LINKS))
    split = members.filter("parts > 1")
    if split.isEmpty():
        return links
    known = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    # A group's first set is its smallest id, so its component's root is the group's number.
    split = staged(split.join(known, "id", "left").withColumn("seen", F.coalesce("root", "id")).select("grp", "id", "n", "tokens", "seen"))
    met = staged(_met(prefixes, split))
    visits = met.join(split.withColumn("visitor", F.col("seen") != F.col("grp")), "id")
    more = visits.select("task", "id", "n", "tokens", "seen", "visitor").groupBy("task").applyInArrow(_joined, LINKS)
    return links.unionByName(staged(more))


def _classed(blocks: DataFrame, width: int) -> DataFrame:
    """block, row, doc_id, n_shingles, component_id of every document."""
    rows = _rows(blocks, width)
    opened = rows.filter("open")
    classes = staged(opened.groupBy("key1", "key2", "n_shingles").agg(F.min("doc_id").alias("id")))
    # One row for each class: its own first document, whose set is that of all.
    reps = opened.select("key1", "key2", "n_shingles", F.col("doc_id").alias("id"), "tokens").join(classes, ["key1", "key2", "n_shingles", "id"], "left_semi")
    reps = reps.dropDuplicates(["key1", "key2", "n_shingles", "id"]).select("id", F.col("n_shingles").alias("n"), "tokens")
    ranked = _ranked(staged(reps))
    links = _links(ranked).select(F.col("id").alias("a"), F.col("root").alias("b"))
    # Rows of one doc_id with different texts are one node.
    named = components(links.unionByName(opened.select("doc_id", "key1", "key2", "n_shingles").join(classes, ["key1", "key2", "n_shingles"]).filter("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))))
    found = rows.select("block", "row", "doc_id", "n_shingles").join(named.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return found.select("block", "row", "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Words are runs of other characters than space and the controls 9 to 13, A-Z lower-cased; a shingle is `width` words in a
    row, or all words of a document that has fewer. component_id is the smallest doc_id that links reach. Documents without words (or text) have no shingles and
    link with nothing; so do rows without doc_id, whose component is null. Rows that repeat a doc_id count as one document. Other
    columns are ignored.
    """
    blocks = B.packed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), BLOCK_BYTES)
    return _classed(blocks, width).select("doc_id", "n_shingles", "component_id")


def without_near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of docs, all columns, with one document of each component: that with the smallest doc_id.

    Of rows that repeat it the first stays. Documents without words and rows without doc_id all stay.
    """
    blocks = B.packed(docs, BLOCK_BYTES)
    classed = staged(_classed(blocks, width))
    single = classed.filter("n_shingles = 0 OR doc_id IS NULL").select("block", "row")
    first = classed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("component_id").agg(F.min(F.struct("doc_id", "block", "row")).alias("x")).select("x.block", "x.row")
    stays = single.unionByName(first).groupBy("block").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, rows in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays(B.opened(body.as_py()).take(rows.values.slice(0)).columns, names=names)

    return blocks.join(stays, "block").select("body", "rows").mapInArrow(keep, docs.schema)
