"""Operator 7: near duplicates by a chosen-path set similarity join.

A text's set holds its distinct shingles of five words. Equal sets are one record from the start. Records are
embedded by ``COORDINATES`` minwise tokens. Each of ``TREES`` trees sends every record down a path: at a node a coordinate is
chosen by the node's own hash, and records with the same token there share a child. A node of at most ``SMALL``
records is compared exhaustively by estimated similarity. In a larger one, records are compared with ``PIVOTS``
pivots and linked to the least one that is likely similar: those very like a pivot, or fairly like several, stay with them (whatever is similar
to them is like the pivots too), and the rest branches again, by two coordinates a level, so that a similar pair is rarely parted. A pair at the threshold misses all trees with
a chance of about 0.25^10. A node that is still large after ``DEPTH`` levels is compared in blocks.

Candidates are then confirmed on full sets, group by group of the candidates' components: a group's texts are
compared exactly, except those that are linked already. Groups of more than ``GROUP`` are split into parts that share pivots;
what isn't linked to the group's largest part-spanning component is compared with the whole group afterwards,
so all pairs but those inside that component are covered, and no pairs are listed.

Result: one row per document with the smallest doc_id of its component. No words: an empty set, linked with nothing. Documents with
equal sets are linked even at the same doc_id. Null doc_ids are linked like others but are never a component's name
unless it has no other; ``kept`` compares null-safely. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexis.llm.common import among, bitmap, discard, is_set, map_rows, saved, table
from lexis.llm.components import components
from lexis.llm.substring_dedup import HASHES, runs_of

WORDS, PERCENT = 5, 75
COORDINATES, TREES, DEPTH = 64, 10, 6
SMALL, PIVOTS = 512, 16
#: Texts of a group that are confirmed together.
GROUP = 128
#: Agreeing coordinates from which a pair is a candidate (0.75 of 64 are 48, with a deviation of 3.5); a record stays with
#: the pivots of a large node if it agrees in ALIKE with one of them or in FAIRLY with ENOUGH of them.
LIKELY, ALIKE, FAIRLY, ENOUGH = 33, 54, 46, 4
#: Records of a large node that one task compares with its pivots.
SHARE = 4000
#: Bits of the map of rows that go, and of the smaller map of each level's records in large nodes, powers of two.
BITS, FEW_BITS = 1 << 22, 1 << 18
#: Shingles of a part of a group.
WEIGHT = 2_000_000

_RANDOM = np.random.default_rng(20240607)
_A = _RANDOM.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; A to Z are lowered."""
    words = [w for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]
    if not words:
        return np.zeros(0, np.uint64)
    hashes = HASHES.of(words)
    if len(words) < WORDS:
        return runs_of(hashes, len(words)) ^ np.uint64(len(words))
    return np.unique(runs_of(hashes, WORDS))


def minwise(found: np.ndarray) -> np.ndarray:
    """Least token of a set under each coordinate's hash, as 31 bits."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(found), 2048):
        np.minimum(least, (found[a : a + 2048, None] * _A + _B).min(axis=0), out=least)
    return (least >> np.uint64(33)).astype(np.int32)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)

    def stars(self) -> list[tuple[int, int]]:
        return [(i, r) for i in range(len(self.up)) if (r := self.find(i)) != i]


def _by_group(df: DataFrame, keys: list[str], columns: list[str], work, schema: str) -> DataFrame:
    """``work`` on the rows of each group of ``keys`` in turn; a group is bounded and comes sorted."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        key, held = None, []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(keys) + len(columns)))):
                if row[: len(keys)] != key:
                    if len(held) > 1:
                        out += work(held)
                    key, held = row[: len(keys)], []
                held.append(row[len(keys) :])
            yield _links(out, names)
        yield _links(work(held) if len(held) > 1 else [], names)

    return df.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _links(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names)


def _sketched(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
    """Stars of candidates among all records of a small node (id, sig)."""
    ids = [r[0] for r in rows]
    sigs = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.uint8).reshape(len(ids), COORDINATES)
    union = Union(len(ids))
    for i in range(len(ids) - 1):
        for j in np.flatnonzero((sigs[i + 1 :] == sigs[i]).sum(axis=1) >= LIKELY).tolist():
            union.join(i, i + 1 + j)
    return [(ids[i], ids[j]) for i, j in union.stars()]


def _with_pivots(batches):
    """Rows (node, share, rank, id, sig) of large nodes, pivots (rank 0) first, to (node, id, other, stays).

    Each record has one row with the least pivot that it is like, or none, and each two pivots that a record joins have one.
    Pivots are a node's least ids, which are hashes: nodes of different trees mostly share them, so their links coincide."""
    key, pivots, sigs, joined = None, [], None, set()
    for batch in batches:
        out: list[tuple] = []
        for node, share, rank, own, sig in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (node, share) != key:
                key, pivots, sigs, joined = (node, share), [], None, set()
            if rank == 0:
                pivots.append((own, sig))
                continue
            if sigs is None:
                sigs = np.frombuffer(b"".join(p[1] for p in pivots), dtype=np.uint8).reshape(len(pivots), COORDINATES)
            agree = (sigs == np.frombuffer(sig, dtype=np.uint8)).sum(axis=1)
            agree[[p[0] == own for p in pivots]] = 0
            near = np.flatnonzero(agree >= LIKELY)
            if not len(near):
                out.append((node, own, None, False))
                continue
            best = int(near[0])
            out.append((node, own, pivots[best][0], bool(agree.max() >= ALIKE or (agree >= FAIRLY).sum() >= ENOUGH)))
            for n in near.tolist():
                if n != best and (best, n) not in joined:
                    joined |= {(best, n), (n, best)}
                    out.append((node, pivots[best][0], pivots[n][0], None))
        columns = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.bool_()))], ["node", "id", "other", "stays"])


def candidates(records: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) of likely pairs among ``records`` (id, mins, sig), as stars within nodes, and the tables that hold them."""
    chosen = [int(c) for c in np.random.default_rng(7).permutation(COORDINATES)[:TREES]]
    roots = F.array(*(F.xxhash64(F.lit(t), F.element_at("mins", c + 1)) for t, c in enumerate(chosen)))
    members = records.select("id", F.explode(roots).alias("node"))
    # both sides of these joins grow with the records, so neither is sent to all
    sigs = records.select("id", "sig").hint("merge")
    found, tables = None, []
    for depth in range(DEPTH + 1):
        sizes = saved(members.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "nodes", thin=True)
        small = members.join(sizes.filter(f"n <= {SMALL}").select("node").hint("merge"), "node").join(sigs, "id")
        links = saved(_by_group(small, ["node"], ["id", "sig"], _sketched, "a binary, b binary"), "candidates", thin=True)
        found = links if found is None else found.unionByName(links)
        tables.append(links)
        # few: at most one for SMALL members; written, so Spark sees their size
        large = saved(sizes.filter(f"n > {SMALL}").select("node", "n"), "large", thin=True)
        if large.isEmpty():
            break
        large_members = saved(members.join(large, "node"), "held", thin=True)
        held = large_members.select("id")
        sigs_held = among(sigs, held, ["id"], FEW_BITS)
        if depth == DEPTH:
            blocks = F.ceil(F.col("n") / (SMALL // 2)).cast("int")
            own = F.pmod(F.xxhash64("id"), blocks).cast("int")
            pairs = large_members.join(sigs_held, "id").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            pairs = pairs.select("node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "sig")
            tables.append(saved(_by_group(pairs, ["node", "i", "j"], ["id", "sig"], _sketched, "a binary, b binary"), "candidates", thin=True))
            found = found.unionByName(tables[-1])
            break
        shares = F.ceil(F.col("n") / SHARE).cast("int")
        rank = F.row_number().over(Window.partitionBy("node").orderBy("id"))
        pivots = large_members.withColumn("rank", rank).filter(f"rank <= {PIVOTS}").join(sigs_held, "id")
        pivots = pivots.select("node", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), F.lit(0).alias("rank"), "id", "sig")
        rest = large_members.join(sigs_held, "id").select("node", F.pmod(F.xxhash64("id"), shares).cast("int").alias("share"), F.lit(1).alias("rank"), "id", "sig")
        dealt = pivots.unionByName(rest).repartition("node", "share").sortWithinPartitions("node", "share", "rank", "id")
        near = saved(dealt.mapInArrow(_with_pivots, "node bigint, id binary, other binary, stays boolean"), "near", thin=True)
        tables.append(near)
        found = found.unionByName(near.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
        branching = near.filter("not stays").select("id", "node").join(among(records.select("id", "mins"), held, ["id"], FEW_BITS).hint("merge"), "id")
        child = F.explode(F.array(*(F.xxhash64("node", F.lit(j), F.get("mins", F.pmod(F.xxhash64("node", F.lit(j)), F.lit(COORDINATES)).cast("int"))) for j in range(2))))
        before, members = members, saved(branching.select("id", child.alias("node")).distinct(), "members", thin=True)
        discard(before, sizes, large, large_members)
    discard(members, sizes, large)
    return found, tables


def _confirmed(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
    """Stars of true links among a group's texts (id, text, side). Rows of side 1 are compared with all, those of side 0 only with side 1; without side 1, all are compared."""
    rows = sorted({r[0]: r for r in sorted(rows, key=lambda r: r[2])}.values(), key=lambda r: (-r[2], r[0]))
    ids, sets, side = [r[0] for r in rows], [shingles(r[1]) for r in rows], [r[2] for r in rows]
    union, some = Union(len(ids)), any(side)
    for i in range(len(ids) - 1):
        if some and not side[i]:
            break
        for j in range(i + 1, len(ids)):
            if union.find(i) != union.find(j) and linked(sets[i], sets[j]):
                union.join(i, j)
    return [(ids[i], ids[j]) for i, j in union.stars()]


def classes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, part (a hash of the text), n (shingles) and root, the component's least record (null for empty sets)."""

    def sketch():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, sizes, mins, sigs = [], [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py())
                sizes.append(len(found))
                ids.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                mins.append(minwise(found) if len(found) else None)
                sigs.append(mins[-1].astype(np.uint8).tobytes() if len(found) else None)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(mins, pa.list_(pa.int32())), pa.array(sigs, pa.binary())], ["doc_id", "part", "id", "n", "mins", "sig"])

        return each

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("part", F.xxhash64("text"))
    each = saved(map_rows(rows, ["doc_id", "part", "text"], sketch, "doc_id bigint, part bigint, id binary, n bigint, mins array<int>, sig binary"), "sketches")
    # one row per set; its text is that of the row with the least place
    place = F.struct(F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("part").alias("t"))
    records = saved(each.filter("n > 0").groupBy("id").agg(F.min(place).alias("place"), F.first("n").alias("n"), F.first("mins").alias("mins"), F.first("sig").alias("sig")), "records")
    links, tables = candidates(records.select("id", "mins", "sig"))
    groups = components(links)
    discard(*tables)
    # texts of records in groups, once each
    wanted = groups.join(records.select("id", "place", "n").hint("merge"), "id").select("root", "id", "n", F.col("place.d").alias("d"), F.col("place.t").alias("t"))
    wanted = saved(wanted, "wanted", thin=True)
    texts = rows.select(F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("part").alias("t"), "text")
    texts = among(texts, wanted, ["d", "t"]).join(wanted.hint("merge"), ["d", "t"])
    texts = saved(texts.select("root", "id", "n", "text").dropDuplicates(["id"]), "texts")
    sizes = saved(texts.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).withColumn("parts", F.greatest(F.ceil(F.col("size") / GROUP), F.ceil(F.col("weight") / WEIGHT)).cast("int")), "groups", thin=True)
    split = texts.join(sizes, "root")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("id"), "id"))
    shared = texts.select("root", "id").join(sizes.filter("parts > 1"), "root").withColumn("rank", rank).filter(f"rank <= {PIVOTS}").select("root", "id", "parts")
    pivots = shared.join(texts.drop("root", "n"), "id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    compared = split.withColumn("part", part).select("root", "part", "id", "text").unionByName(pivots.select("root", "part", "id", "text")).withColumn("side", F.lit(0))
    links = saved(_by_group(compared, ["root", "part"], ["id", "text", "side"], _confirmed, "a binary, b binary"), "confirmed", thin=True)
    whole = components(links)
    large = sizes.filter("parts > 1").select("root", "parts")
    if not large.isEmpty():
        # ids of split groups outside the group's largest component so far
        inside = texts.select("root", "id").join(large, "root").join(whole.withColumnRenamed("root", "class"), "id", "left").withColumn("class", F.coalesce("class", "id"))
        count = inside.groupBy("root", "class").agg(F.count("*").alias("n"))
        main = count.groupBy("root").agg(F.max_by("class", F.struct("n", "class")).alias("main"))
        outside = inside.join(main, "root").filter("class <> main").select("root", "id", "parts")
        outside = saved(outside, "outside", thin=True)
        if not outside.isEmpty():
            per = outside.groupBy("root").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks"))
            block = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")
            asks = outside.join(per, "root").withColumn("block", block).join(texts.drop("root", "n"), "id")
            asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("root", "block", "part", "id", "text", F.lit(1).alias("side"))
            all_ = split.join(per, "root").withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", "block", "part", "id", "text", F.lit(0).alias("side"))
            more = saved(_by_group(asks.unionByName(all_), ["root", "block", "part"], ["id", "text", "side"], _confirmed, "a binary, b binary"), "confirmed", thin=True)
            whole = components(links.unionByName(more))
    discard(texts, sizes)
    return each.drop("mins", "sig").join(whole, "id", "left").select("doc_id", "part", "n", F.when(F.col("n") > 0, F.coalesce("root", "id")).alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    classed = classes(docs)
    names = classed.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("many")).filter("many > 1").drop("many")
    named = classed.join(names, "root", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that with the least doc_id and text hash, and all rows without words."""
    classed = saved(classes(docs), "classes", thin=True)
    place = F.struct("doc_id", "part")
    names = classed.filter("n > 0").groupBy("root").agg(F.min(place).alias("name"), F.count("*").alias("many")).filter("many > 1").select("root", "name")
    others = classed.join(names, "root").filter(place != F.col("name")).select(F.coalesce("doc_id", F.lit(0)).alias("__d"), F.col("part").alias("__t"), F.col("doc_id").isNull().alias("__n")).distinct()
    keyed = docs.withColumn("__d", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))).withColumn("__t", F.xxhash64("text")).withColumn("__n", F.col("doc_id").isNull())
    # only rows that a bitmap of the others may hold are joined with them, so most texts aren't shuffled
    others = saved(others, "others", thin=True)
    bit = f"(xxhash64(__d, __t, __n) & {BITS - 1}L)"
    doubtful = is_set(bitmap(others, bit, BITS), bit)
    kept = keyed.filter(~doubtful).unionByName(keyed.filter(doubtful).join(others, ["__d", "__t", "__n"], "left_anti"))
    if not classed.filter("n > 0").groupBy("doc_id", "part").count().filter("count > 1").isEmpty():
        # rows that repeat both
        empty = F.trim(F.coalesce("text", F.lit(""))) == ""
        kept = kept.filter(~empty).dropDuplicates(["__d", "__t", "__n"]).unionByName(kept.filter(empty))
    return kept.select(*(f"`{c}`" for c in docs.columns))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
