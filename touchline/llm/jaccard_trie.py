"""N-gram Jaccard join by prefix trees.

Documents become sets of hashed word n-grams.  Sets that are equal are one
class.  What cannot have a partner is ruled out exactly, and the rest is split
into families that no link leaves; inside a family the globally ordered sets
stand in a trie that every set is looked up in.

Bounds.  With similarity at least t, two linked sets of sizes a and b share at
least o(a) = ceil(t*a) and o(b) n-grams.  In any global order the l-th common
n-gram is then among the first a - o(a) + l of one set and b - o(b) + l of the
other.

1. Order by hash.  With l = a tenth of the size, a set must share at least
   l(o(a)) n-grams of this longer prefix with other sets' prefixes.  A count
   per n-gram decides it; no pair is formed.
2. Order by rising document frequency among what is left.  N-grams of one set
   alone come first and use up the prefix; sets that have too many of them are
   ruled out, the others keep cnt - o(a) + 1 of their cnt shared n-grams.  From
   here on a set is its shared n-grams and its whole size.
3. Sets that share one of those are joined into families (components).
4. Inside a family only sets of the same or the next size class (a factor 1/t)
   meet, in blocks of at most BLOCK sets.  One side of a block pair stands in
   a trie, most frequent n-gram first, so near copies share one long path.  A
   look-up goes down level by level, adds up the overlap of a path once for
   all sets below it, and drops a subtree when the overlap so far and what is
   left of either side cannot reach the overlap that the least set needs.

N-grams are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from touchline.llm.components import components, local_components, settle
from touchline.llm.groups import flat, row_key, runs, small
from touchline.llm.text import SPACED, lists, mix, slices, words_of
from touchline.sources.stage import stage

BLOCK = 1000
BLOCK_GRAMS = 1_000_000

SETS = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("cls", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType(), False)),
])
HITS = T.StructType([
    T.StructField("cls", T.LongType()), T.StructField("links", T.LongType()), T.StructField("root", T.LongType()),
])


def needed(n, num: int, den: int):
    """Least overlap a set of n n-grams has with any linked set."""
    return -(-n * num // den)


def extra(n):
    """l of step 1; grows with n."""
    return np.maximum(1, n // 10)


def _sets(k: int, num: int, den: int, whole: bool):
    """Sets of n-grams, sorted by hash: all of each, or the prefix of step 1."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column(1), SPACED, lower=True)
                counts = words.counts
                ok, gram, doc = words.valid(k), words.grams(k), words.doc
                ok, gram, doc = ok[: len(gram)], gram[ok], doc[ok]
                for d in np.flatnonzero((counts > 0) & (counts < k)):
                    whole_text = np.uint64(counts[d])
                    for h in words.hash[words.first[d]: words.first[d + 1]]:
                        whole_text = mix(np.array([whole_text], np.uint64) * np.uint64(31) + h)[0]
                    gram, doc = np.append(gram, whole_text), np.append(doc, d)
                order = np.lexsort((gram, doc))
                gram, doc = gram[order], doc[order]
                first = np.ones(len(gram), bool)
                first[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
                gram, doc = gram[first], doc[first]
                n = np.bincount(doc, minlength=words.n_docs)
                total = np.zeros(words.n_docs, np.uint64)
                np.add.at(total, doc, mix(gram + np.uint64(1)))
                cls = mix(total ^ mix(n.astype(np.uint64)))
                kept = n
                if not whole:
                    kept = np.minimum(n, n - needed(n, num, den) + extra(n))
                    rank = np.arange(len(gram)) - np.repeat(np.cumsum(n) - n, n)
                    gram = gram[rank < np.repeat(kept, n)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(n, pa.int64()), pa.array(cls.view(np.int64)),
                    lists(gram.view(np.int64), kept, pa.int64()), *part.columns[2:],
                ], names=[*SETS.names, *part.schema.names[2:]])

    return make


class Trie:
    """Radix tree over the sets, each sorted by the global order."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.rows = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        parent, begin, end, owner, ends_here = [-1], [0], [0], [0], [[]]
        stack = [0]
        before = np.zeros(0, np.int64)
        for row in self.rows:
            now = sets[row]
            m = min(len(before), len(now))
            differ = np.flatnonzero(before[:m] != now[:m])
            shared = int(differ[0]) if len(differ) else m
            while end[stack[-1]] > shared and begin[stack[-1]] >= shared and len(stack) > 1:
                stack.pop()
            top = stack[-1]
            if end[top] > shared:  # cut the node in two; the new one is the upper part
                upper = len(parent)
                parent.append(parent[top]), begin.append(begin[top]), end.append(shared), owner.append(owner[top])
                ends_here.append([])
                parent[top], begin[top] = upper, shared
                stack[-1] = top = upper
            if len(now) > shared:
                node = len(parent)
                parent.append(stack[-1]), begin.append(shared), end.append(len(now)), owner.append(row)
                ends_here.append([row])
                stack.append(node)
            else:
                ends_here[top].append(row)
            before = now
        self.parent = np.array(parent)
        lengths = np.array(end) - np.array(begin)
        self.tokens = np.concatenate([sets[o][b:e] for o, b, e in zip(owner, begin, end)] or [np.zeros(0, np.int64)])
        self.at = np.concatenate([[0], np.cumsum(lengths)])
        self.last = np.array([sets[o][e - 1] if e else -1 for o, e in zip(owner, end)])
        self.end = np.array(end)
        self.leaf_at = np.cumsum([0, *map(len, ends_here)])
        self.leaf = np.array([row for x in ends_here for row in x], np.int64)
        # Least size and longest path below each node, from the deepest up.
        count = len(parent)
        self.least = np.full(count, np.iinfo(np.int64).max)
        self.longest = self.end.copy()
        for i, x in enumerate(ends_here):
            if x:
                self.least[i] = sizes[x].min()
        for i in sorted(range(1, count), key=lambda i: -begin[i]):
            p = parent[i]
            self.least[p] = min(self.least[p], self.least[i])
            self.longest[p] = max(self.longest[p], self.longest[i])
        order = np.argsort(self.parent[1:], kind="stable") + 1
        self.children = order
        self.child_at = np.searchsorted(self.parent[order], np.arange(count + 1))

    def find(self, query: np.ndarray, size: int, universe: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may link with the query set, and their overlaps with it."""
        inside = np.zeros(universe + 1, np.int64)
        inside[query] = 1
        after = len(query) - np.cumsum(inside)  # query n-grams beyond a place; index -1 is all
        rows, overlaps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        node, got = np.array([0]), np.array([0])
        while len(node):
            counts = self.child_at[node + 1] - self.child_at[node]
            if not counts.sum():
                break
            base = np.repeat(self.child_at[node] - np.cumsum(counts) + counts, counts)
            kids = self.children[base + np.arange(len(base))]
            got = np.repeat(got, counts)
            length = self.at[kids + 1] - self.at[kids]
            start = np.cumsum(length) - length
            places = np.repeat(self.at[kids] - start, length) + np.arange(length.sum())
            got = got + np.add.reduceat(inside[self.tokens[places]], start)
            most = got + np.minimum(self.longest[kids] - self.end[kids], after[self.last[kids]])
            # den * o >= num * (size + other - o)
            good = (num + den) * most >= num * (size + self.least[kids])
            node, got = kids[good], got[good]
            ends = self.leaf_at[node + 1] - self.leaf_at[node]
            base = np.repeat(self.leaf_at[node] - np.cumsum(ends) + ends, ends)
            rows.append(self.leaf[base + np.arange(len(base))]), overlaps.append(np.repeat(got, ends))
        return np.concatenate(rows), np.concatenate(overlaps)


def block_links(sizes, values, at, role, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (rows) of one block pair: role 0 stands in the trie, 1 looks up, 2 does both.

    N-grams that only one row has stay out of the tree; the sizes count them.
    """
    _, token, counts = np.unique(values, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), np.diff(at))
    several = counts[token] > 1
    token, at = token[several], np.searchsorted(owner[several], np.arange(len(sizes) + 1))
    place = np.empty(len(counts), np.int64)
    place[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    token = place[token]
    sets = [np.sort(token[at[i]: at[i + 1]]) for i in range(len(sizes))]
    inner, outer = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
    trie = Trie([sets[i] for i in inner], sizes[inner])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for q in outer:
        rows, overlap = trie.find(sets[q], int(sizes[q]), len(counts), num, den)
        other = inner[rows]
        good = (num + den) * overlap >= num * (sizes[q] + sizes[other])
        if role[q] == 2:
            good &= other < q
        left.append(np.full(int(good.sum()), q)), right.append(other[good])
    return np.concatenate(left), np.concatenate(right)


def _links(num: int, den: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches, "unit"):
            docs = unit.column("cls").to_numpy()
            sizes, copies = unit.column("n").to_numpy(), unit.column("copies").to_numpy()
            values, at = flat(unit.column("grams"))
            u, v = block_links(sizes, values, at, unit.column("role").to_numpy(), num, den)
            if not len(u):
                continue
            links = np.zeros(len(docs), np.int64)
            np.add.at(links, u, copies[v])
            np.add.at(links, v, copies[u])
            order = np.argsort(docs, kind="stable")
            back = np.empty(len(docs), np.int64)
            back[order] = np.arange(len(docs))
            root = docs[order][local_components(len(docs), back[u], back[v])][back]
            hit = links > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs[hit]), pa.array(links[hit]), pa.array(root[hit])], names=["cls", "links", "root"],
            )

    return find


def _shared(rows: DataFrame, name: str) -> DataFrame:
    """(gram, df) of the n-grams that two classes have at least; df counts rows."""
    counted = rows.groupBy("gram").agg(F.count("*").alias("df"), F.min("cls").alias("low"), F.max("cls").alias("high"))
    return stage(counted.filter("low < high").select("gram", "df"), name)


def jaccard_join(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    n_words: int = 5, num: int = 80, den: int = 100, keep_key: bool = False,
) -> DataFrame:
    """(doc, n_shingles, class_id, n_links, component_id) for every row of ``docs``.

    Words are runs between ASCII white space, A-Z lower-cased; a set has the
    distinct ``n_words``-grams, or the whole sequence for a shorter text.  Two
    sets link when den * |intersection| >= num * |union|.  ``class_id`` is the
    least id with an equal set, ``n_links`` the number of other rows linked
    directly (equal sets included), ``component_id`` the least id that links
    reach, the own one included.

    Texts that are null, empty or without words have an empty set: 0 shingles,
    0 links, their own class and component.  Rows with a null id come back
    with the size of their set, no link and null class and component.  Rows
    that share an id are linked by their own sets alone.  An empty table gives
    an empty table.  Other columns of the input are not looked at and may have
    any name.  With ``keep_key`` there are also ``key``, the hash of id and
    text that a row is known by, and ``component``, which tells components
    apart that have the same least id (null where the id is null or the set empty).
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    keyed, schema = source, SETS
    if keep_key:
        keyed = source.select("doc", "text", row_key("doc", "text").alias("key"))
        schema = T.StructType([*SETS.fields, T.StructField("key", T.LongType())])
    sets = stage(keyed.mapInArrow(_sets(n_words, num, den, whole=False), schema), "sets")
    classes = stage(
        sets.filter("n > 0 and doc is not null").groupBy("cls", "n")
        .agg(F.min("doc").alias("rep"), F.count("*").alias("copies")),
        "classes",
    )
    overlap = f"((n * {num} + {den - 1}) div {den})"
    # Step 1.  All copies of a class have the same n-grams, so the rows of a
    # class are its own n-grams times its copies.
    prefixes = sets.filter("n > 0 and doc is not null").select("cls", F.explode("grams").alias("gram"))
    counts = prefixes.join(_shared(prefixes, "prefix_grams").select("gram"), "gram", "left_semi").groupBy("cls").agg(
        F.count("*").alias("seen"),
    )
    seen = stage(
        counts.join(classes, "cls").filter(F.expr(f"seen >= copies * greatest(1, {overlap} div 10)"))
        .select(F.col("rep").alias("doc"), "cls"),
        "seen",
    )
    # Step 2: whole sets of the rest, made again from the texts.  Rows that
    # repeat a class change no order of n-grams and no list.
    few = small(seen)
    whole = stage(
        source.join(few.select("doc"), "doc", "left_semi")
        .mapInArrow(_sets(n_words, num, den, whole=True), SETS).join(few, ["doc", "cls"], "left_semi").drop("doc"),
        "whole_sets",
    )
    grams = whole.select("cls", F.explode("grams").alias("gram"))
    common = stage(
        grams.join(_shared(grams, "grams"), "gram").groupBy("cls")
        .agg(F.array_distinct(F.sort_array(F.collect_list(F.struct("df", "gram")))["gram"]).alias("grams"))
        .join(classes.select("cls", "n", "copies"), "cls").filter(F.size("grams") >= F.expr(overlap)),
        "common_sets",
    )
    rare = stage(
        common.select("cls", F.explode(
            F.slice("grams", F.lit(1), (F.size("grams") - F.expr(overlap) + 1).cast("int")),
        ).alias("gram")),
        "rare_grams",
    )
    # Step 3.
    owners = stage(rare.groupBy("gram").agg(F.min("cls").alias("b")), "owners")
    edges = rare.join(owners, "gram").select(F.col("cls").alias("a"), "b")
    families = stage(components(edges).select(F.col("node").alias("cls"), F.col("component").alias("family")), "families")
    # Step 4: size classes, blocks, block pairs.
    step = math.log(den / num) * 1.0001 if den > num else 1.0
    sized = common.select("cls", "n", F.size("grams").alias("length")).join(families, "cls").withColumn(
        "level", F.floor(F.log("n") / step).cast("int"),
    )
    counts = sized.groupBy("family", "level").agg(F.count("*").alias("rows"), F.sum("length").alias("grams"))
    counts = counts.withColumn(
        "blocks", F.ceil(F.greatest(F.col("rows") / BLOCK, F.col("grams") / BLOCK_GRAMS)).cast("int"),
    )
    # A family has at most one row per size class here.
    along = Window.partitionBy("family").orderBy("level")
    near = lambda move, gap: F.when(
        move("level").over(along) == F.col("level") + gap, move("blocks").over(along),
    ).otherwise(0)
    counts = stage(counts.select(
        "family", "level", "blocks", near(F.lag, -1).alias("below"), near(F.lead, 1).alias("above"),
    ), "blocks")
    placed = sized.join(counts, ["family", "level"]).withColumn("block", F.expr("cast(pmod(xxhash64(cls), blocks) as int)"))
    meets = F.expr("""
        concat(
          transform(sequence(0, blocks - 1), i -> named_struct(
            'low', level, 'high', level, 'i', least(i, block), 'j', greatest(i, block),
            'role', case when i = block then 2 when block < i then 0 else 1 end)),
          case when above > 0 then transform(sequence(0, above - 1), i -> named_struct(
            'low', level, 'high', level + 1, 'i', block, 'j', i, 'role', 0)) else array() end,
          case when below > 0 then transform(sequence(0, below - 1), i -> named_struct(
            'low', level - 1, 'high', level, 'i', i, 'j', block, 'role', 1)) else array() end)
    """)
    spread = placed.select("cls", F.explode(meets).alias("m"), "family").select(
        "cls", F.xxhash64("family", "m.low", "m.high", "m.i", "m.j").alias("unit"), F.col("m.role").alias("role"),
    )
    hits = stage(
        spread.join(common, "cls").select("unit", "role", "cls", "n", "copies", "grams")
        .repartition("unit").sortWithinPartitions("unit").mapInArrow(_links(num, den), HITS),
        "hits",
    )
    facts = settle(classes, hits)
    known = F.col("doc").isNotNull() & (F.col("n") > 0)
    more = [F.col("key"), F.when(known, F.col("component")).alias("component")] if keep_key else []
    return sets.drop("grams").join(facts, "cls", "left").select(
        "doc", F.col("n").alias("n_shingles"),
        F.when(known, F.col("class_id")).otherwise(F.col("doc")).alias("class_id"),
        F.when(known, F.col("n_links")).otherwise(F.lit(0)).alias("n_links"),
        F.when(known, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"), *more,
    )
