"""MinHash near-duplicates by an inverted join of signature coordinates.

1. One pass makes each text's set of word shingles, a 16-byte name of that set and a signature of COORDINATES
   minima. Texts of equal sets form a class; the smallest doc_id stands for it. Copies go no further.
2. Classes are posted under each (coordinate, value). Values that a single class holds can't collide. Of its
   m shared values a class keeps the m - matches + 1 rarest as its prefix (ties by key): two classes that agree in `matches`
   coordinates have a prefix value in common. Frequent values, such as those of common passages, are skipped.
3. Each posting list is worked off in rounds. Its pivot is compared with the others: collisions are counted on
   the whole signatures, pairs with at least `matches` are confirmed on the full sets, and links are joined to
   components. A list whose other classes are in one component is done. This gives one pair per posting, never all pairs of a group.
4. For lists that are left, shingles that only one of their classes has bound every overlap from above, which
   drops most of what can't link; pivots are then the classes with the most shared mass. After LATER_ROUNDS such
   rounds all pairs of different components that the bounds allow, now with bitmaps of the other shingles, are
   compared, so no link is lost to pivots.

`matches` follows from the similarity asked for: the most for which a pair of just that similarity agrees in fewer of the
COORDINATES coordinates with a chance of at most MISS (22 of 48 at 0.8, where that chance is 3.4e-8); similarities
that not even one match would serve are refused. Every
reported link has been confirmed on whole sets of 64-bit shingle hashes. There is no cap on partners.

Nodes are doc_ids: rows that repeat a doc_id share its component. Null and word-less texts have an empty set and
link with nothing; rows with a null doc_id take no part, keep a null component and are kept. An empty table
gives an empty result; of clashing column names the operator's wins. A text of any length is one row in one Python step.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, release, settle, text_slices
from .components import components
from .shingles import overlap, set_digest, shingle_sets, signatures

COORDINATES = 48
MISS = 1e-7
LATER_ROUNDS = 2
#: Longs in a bitmap of shared shingles; a power of two.
WORDS_64 = 16
#: Bytes of ids and pairs that are broadcast to fetch texts again; with more, a shuffle join does it.
BROADCAST_BYTES = 8 << 20
#: Classes that meet one copy of a pivot's set.
PIVOT_SPLIT = 64


def matches_for(percent: int) -> int:
    """The coordinates in which a pair of that similarity agrees but for a chance of MISS."""
    p, below = percent / 100, 0.0
    for k in range(COORDINATES + 1):
        below += math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)
        if below > MISS:
            if not k:
                raise ValueError(f"{COORDINATES} coordinates can't find similarities of {percent} %")
            return k
    return COORDINATES


def features(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, class (binary), signature (array of int; null for empty sets)."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                values, at = shingle_sets(data, offsets, width)
                sig = signatures(values, at, COORDINATES).view(np.int32)
                sizes = np.diff(at)
                names = [set_digest(values[a:b]) for a, b in zip(at[:-1], at[1:])]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * COORDINATES, pa.int32()), pa.array(sig.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), lists], names=["doc_id", "n_shingles", "class", "signature"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, class binary, signature array<int>")


def prefix_postings(classes: DataFrame, matches: int) -> DataFrame:
    """key, node: the postings of each class in its prefix. classes: node, signature."""
    posted = classes.select("node", F.posexplode("signature").alias("c", "v"))
    posted = posted.select("node", F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))
    shared = settle(posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    own = posted.join(shared, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("own"))  # COORDINATES at most
    kept = own.where(F.size("own") >= matches).select("node", F.explode(F.slice("own", F.lit(1), F.size("own") - (matches - 1))).alias("p"))
    return kept.select(F.col("p.key").alias("key"), "node")


def _texts_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """docs joined with nodes(node, ...) of about `size` bytes on doc_id = node."""
    few = size <= BROADCAST_BYTES
    own = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    return own.join(F.broadcast(nodes) if few else nodes, "node")


def confirm(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The pairs(pivot, node) whose full sets have 100 * intersection >= percent * union; and the tables that this reads.

    Each text is read once and sent, as a set, once for each of its pairs; a pivot's own set goes ahead of each
    PIVOT_SPLIT of its partners.
    """
    splits = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / PIVOT_SPLIT).cast("int").alias("splits"))
    splits = settle(splits, "splits")
    own = splits.select(F.col("pivot").alias("node"), F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("salt"), F.col("node").alias("pivot"), F.lit(0).alias("role"))
    others = pairs.join(splits, "pivot").select("node", F.pmod(F.xxhash64("node"), F.col("splits")).cast("int").alias("salt"), "pivot", F.lit(1).alias("role"))
    asked = own.unionByName(others).groupBy("node", F.pmod(F.xxhash64("pivot", "salt"), F.lit(64)).alias("part")).agg(F.collect_list(F.struct("pivot", "salt", "role")).alias("asked"))
    asked = settle(asked.drop("part"), "asked")

    def sets(batches):
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                values, at = shingle_sets(data, offsets, width)
                rows, size = [], 0
                for i, (node, wanted) in enumerate(zip(part.column("node").to_pylist(), part.column("asked").to_pylist())):
                    raw = values[at[i] : at[i + 1]].tobytes()
                    for w in wanted:
                        rows.append((w["pivot"], w["salt"], w["role"], node, raw))
                        size += len(raw)
                        if size > 4 << 20:
                            yield _rows(rows)
                            rows, size = [], 0
                if rows:
                    yield _rows(rows)

    fields = [("pivot", pa.int64()), ("salt", pa.int32()), ("role", pa.int32()), ("node", pa.int64()), ("shingles", pa.binary())]

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    def compare(batches):
        at, own = None, []
        for batch in batches:
            pivots, nodes = [], []
            for pivot, salt, role, node, raw in zip(*(batch.column(n).to_pylist() for n, _ in fields)):
                if at != (pivot, salt):
                    at, own = (pivot, salt), []
                values = np.frombuffer(raw, np.uint64)
                if not role:
                    own.append(values)
                    continue
                for mine in own:
                    both = overlap(mine, values)
                    if 100 * both >= percent * (len(mine) + len(values) - both):
                        pivots.append(pivot)
                        nodes.append(node)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(pivots, pa.int64()), pa.array(nodes, pa.int64())], names=["a", "b"])
        release()

    rows, asked_for = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("asked")), F.lit(0))).first()
    sent = _texts_of(docs, asked, 64 * rows + 48 * asked_for).select("node", "text", "asked").mapInArrow(sets, "pivot long, salt int, role int, node long, shingles binary")
    dealt = sent.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role")
    return dealt.mapInArrow(compare, "a long, b long"), [splits, asked]


def masses(docs: DataFrame, units: DataFrame, width: int) -> DataFrame:
    """unit, node, n, m, b0 ...: the shingles of each class, how many of them some other class has too, and those as a bitmap of WORDS_64 longs.

    units: unit, node, class, n, a row for each class that a node stands for. Repeated rows of a node count once, and
    its rows of other classes don't count.
    """

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                values, at = shingle_sets(data, offsets, width)
                own = np.array([set_digest(values[a:b]) == name for a, b, name in zip(at[:-1], at[1:], part.column("class").to_pylist())], bool)
                owner = np.repeat(np.array(part.column("unit").to_pylist(), np.int64), np.diff(at))
                kept = np.repeat(own, np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(owner[kept]), pa.array(values.view(np.int64)[kept])], names=["unit", "shingle"])

    own = _texts_of(docs, units, 80 * units.count()).select("unit", "class", "text").mapInArrow(run, "unit long, shingle long")
    own = settle(own.dropDuplicates(["unit", "shingle"]), "shingles")
    shared = settle(own.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("shingle"), "shared-shingles")
    bit = F.shiftrightunsigned("shingle", 64 - 6 - WORDS_64.bit_length() + 1)
    word = F.shiftright(bit, 6)
    maps = [F.bit_or(F.when(word == j, F.expr("shiftleft(1L, int(bit & 63))")).otherwise(F.lit(0).cast("long"))).alias(f"b{j}") for j in range(WORDS_64)]
    found = own.join(shared, "shingle").withColumn("bit", bit).groupBy("unit").agg(F.count(F.lit(1)).alias("m"), *maps)
    return units.select("unit", "node", "n").join(found, "unit", "left").fillna(0)


def may_link(percent: int, bitmaps: bool) -> Column:
    """Whether the bounds allow a pair to link: what only one of the two can have is at most what the similarity allows.

    The symmetric difference holds the shingles that no other node has, and at least one for each bit that
    differs in the bitmaps of the others.
    """
    apart = F.col("n") - F.col("m") + F.col("pivot_n") - F.col("pivot_m")
    shared = F.least("m", "pivot_m")
    out = (100 * shared >= percent * (F.col("n") + F.col("pivot_n") - shared)) & ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("pivot_n")))
    if bitmaps:
        differ = sum((F.bit_count(F.col(f"b{j}").bitwiseXOR(F.col(f"pivot_b{j}"))) for j in range(1, WORDS_64)), F.bit_count(F.col("b0").bitwiseXOR(F.col("pivot_b0"))))
        out = out & ((100 + percent) * (apart + differ) <= (100 - percent) * (F.col("n") + F.col("pivot_n")))
    return out


class _Work:
    """The lists that are left, the links so far and the components they give."""

    def __init__(self, docs, classes, width, percent):
        self.docs, self.classes, self.width, self.percent = docs, classes, width, percent
        self.matches = matches_for(percent)
        self.links: DataFrame | None = None
        self.comps: DataFrame | None = None

    def retain(self, pairs: DataFrame) -> DataFrame:
        """Counts the collisions of distinct pairs(pivot, node) on the whole signatures."""
        side = lambda c: self.classes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}"))
        both = pairs.distinct().join(side("node"), "node").join(side("pivot"), "pivot")
        both = both.where(100 * F.least("n_node", "n_pivot") >= self.percent * F.greatest("n_node", "n_pivot"))
        hits = F.aggregate(F.zip_with("s_node", "s_pivot", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
        return settle(both.where(hits >= self.matches).select("pivot", "node"), "pairs")

    def link(self, pairs: DataFrame) -> None:
        kept = self.retain(pairs)
        confirmed, read = confirm(self.docs, kept, self.width, self.percent)
        found = settle(confirmed, "links")
        discard(kept, *read, *([self.comps] if self.comps is not None else []))
        self.links = found if self.links is None else self.links.unionByName(found)
        self.comps = settle(components(self.links), "components")

    def open_lists(self, lists: DataFrame) -> DataFrame:
        """The lists whose nodes are in more than one component: key, node, component and the other columns."""
        known = lists.drop("component").join(self.comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = known.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        return settle(known.join(settle(mixed, "open"), "key"), "lists")


def near_links(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between classes that have the components of all links. classes: node, n_shingles, signature, class."""
    work = _Work(docs, classes, width, percent)
    lists = settle(prefix_postings(classes, work.matches), "prefix")
    pivots = settle(lists.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("r"), F.col("node").alias("p"))).alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.col("p.p").alias("pivot")), "pivots")
    starred = lists.join(pivots, "key").where("node <> pivot")
    work.link(starred.select("pivot", "node"))
    lists = work.open_lists(starred.select("key", "node"))

    nodes = settle(lists.select("node").distinct(), "nodes")
    if nodes.isEmpty():
        return work.links
    # a node that stands for two classes is in its lists once for each
    units = settle(classes.join(nodes, "node").select(F.monotonically_increasing_id().alias("unit"), "node", "class", F.col("n_shingles").alias("n")), "units")
    extra = settle(masses(docs, units, width).where(100 * F.col("m") >= percent * F.col("n")), "masses")
    lists = work.open_lists(lists.select("key", "node").distinct().join(extra.select("node", "unit", "n", "m"), "node"))
    for _ in range(LATER_ROUNDS):
        if lists.isEmpty():
            return work.links
        best = F.min(F.struct((F.lit(1.0) - F.col("m") / F.col("n")).alias("r"), F.xxhash64("node").alias("h"), F.col("node").alias("p"), F.col("component").alias("c"), F.col("n").alias("n"), F.col("m").alias("m"), F.col("unit").alias("u")))
        best = lists.groupBy("key").agg(best.alias("b")).select("key", F.col("b.p").alias("pivot"), F.col("b.c").alias("pivot_c"), F.col("b.n").alias("pivot_n"), F.col("b.m").alias("pivot_m"), F.col("b.u").alias("pivot_unit"))
        starred = lists.join(settle(best, "pivots"), "key").where("unit <> pivot_unit")
        work.link(starred.where(may_link(percent, False) & (F.col("component") != F.col("pivot_c"))).select("pivot", "node"))
        lists = work.open_lists(starred.select("key", "node", "unit", "n", "m"))
    if lists.isEmpty():
        return work.links
    # the smaller side of each pair: nodes outside the list's most common component
    size = lists.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    main = settle(size.groupBy("key").agg(F.max(F.struct("c", "component")).alias("b")).select("key", F.col("b.component").alias("main")), "main")
    marked = lists.join(main, "key").join(extra.drop("node", "n", "m"), "unit")
    left = marked.where("component <> main").withColumnsRenamed({"node": "pivot", "component": "pivot_c"} | {c: f"pivot_{c}" for c in extra.columns if c not in ("node", "unit")}).drop("main", "unit")
    rest = (F.col("component") != F.col("pivot_c")) & ((F.col("component") == F.col("main")) | (F.col("node") > F.col("pivot")))
    work.link(marked.join(left, "key").where(rest & may_link(percent, True)).select("pivot", "node"))
    return work.links


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text)."""
    docs = docs.select("doc_id", "text")
    rows = settle(features(docs, width), "features")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    heads = settle(full.groupBy("class").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "heads")
    # the rows that stand for their class; a repeated row may stand twice, which does no harm but is dropped here
    classes = settle(full.join(heads.select(F.col("node").alias("doc_id"), F.col("class").alias("c")), "doc_id").where(F.col("class") == F.col("c")).select(F.col("doc_id").alias("node"), "n_shingles", "signature", "class").dropDuplicates(["class"]), "classes")
    copies = full.join(heads.where("n > 1"), "class").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = settle(components(near_links(docs, classes, width, percent).unionByName(copies)), "found")
    out = rows.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def oracle_sql(width: int, percent: int) -> str:
    """near_duplicates() over the view `documents` in DuckDB's SQL, by counting shared shingles; for small tables."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
with recursive d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select rid, doc_id, case when len(w) = 0 then [] else list_sort(list_distinct(list_transform(range(greatest(1, len(w) - {width - 1})), lambda i: array_to_string(w[i + 1 : i + {width}], ' ')))) end as sh from d),
own as (select rid, doc_id, len(sh)::bigint as n, md5(array_to_string(sh, chr(10))) as name from s where len(sh) > 0 and doc_id is not null),
class as (select name, min(doc_id) as node, min(rid) as rid, any_value(n) as n from own group by name),
post as (select c.name, c.node, c.n, unnest(s.sh) as g from class c join s on s.rid = c.rid),
pair as (select a.node as x, b.node as y, count(*) as shared, any_value(a.n) as nx, any_value(b.n) as ny from post a join post b on a.g = b.g and a.name < b.name group by a.name, b.name, a.node, b.node),
link as (select x, y from pair where 100 * shared >= {percent} * (nx + ny - shared) union select o.doc_id, c.node from own o join class c using (name) where o.doc_id <> c.node),
edge as (select x, y from link union select y, x from link),
reach as (select doc_id as node, doc_id as component from own union select e.y, r.component from reach r join edge e on e.x = r.node),
best as (select node, min(component) as component from reach group by node)
select s.doc_id, len(s.sh)::bigint as n_shingles, coalesce(b.component, s.doc_id) as component_id, s.doc_id is not distinct from coalesce(b.component, s.doc_id) as kept from s left join best b on b.node = s.doc_id"""
