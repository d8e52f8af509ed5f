"""Operator 11: compression of vectors into short codes by one codebook for each part of the vector.

1. Vectors are cut into ``parts`` equal consecutive parts, and each component x becomes the integer floor(``SCALE`` * x). Each part's codebook
   starts as that part of the ``entries`` vectors of the least ids.
2. A round broadcasts the codebooks (``parts`` * ``entries`` * part length integers, whatever the number of rows). Arrow batches get all squared
   distances of a part at once, as |x|^2 - 2xc + |c|^2 with products of int64 matrices, and take the first least one. A task adds up its
   parts by entry and hands on one row for each used entry, so the grouped shuffle that merges the sums grows with tasks, not with rows.
3. After the last round, codes and errors are written once, and the errors are summed by label.

All arithmetic is in integers. Components whose integers are too large for 64-bit distances are computed as Python's unlimited integers in that
batch; an error beyond 64 bits raises an OverflowError rather than wrapping around.

Rows go whose vector is null or holds a null, a NaN or an infinity, or that has another length than the vector of the least kept id (the length of the
space). With fewer kept rows than ``entries`` the codebooks are as short. A length that ``parts`` doesn't divide raises a ValueError; vectors of
length 0 have the code 00 in each part and no error. Repeated ids are repeated rows; ties of ids at the start go by the components, and a null id comes last. Null labels are
one label. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.llm.common import saved, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose distances are computed together: a matrix of this by ``entries`` integers.
BLOCK = 256
#: Groups of ids whose least ones bound the ids that the codebooks start from.
MINIMA = 4096
#: Labels' sums are copied so many times, so that rows of one label go to as many tasks.
SALTS = 32


class Codebooks:
    """The entries of all parts, and assignment to them."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books
        self.largest = max((int(np.abs(b).max()) for b in books if b.size), default=0)

    def exact(self, block: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Block and codebooks as integers in which distances can't overflow."""
        largest = max(int(np.abs(block).max()) if block.size else 0, self.largest)
        if 4 * largest * largest * max(1, block.shape[1]) < 1 << 62:
            return block, self.books
        return block.astype(object), [b.astype(object) for b in self.books]

    def assign(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each part and the sum of squared distances of each row of ``block`` (rows by components)."""
        block, books = self.exact(block)
        width, codes, error = books[0].shape[1], np.zeros((len(block), len(books)), dtype=np.int64), np.zeros(len(block), dtype=block.dtype)
        for n, book in enumerate(books):
            x = block[:, n * width : (n + 1) * width]
            distances = (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)[None, :]
            codes[:, n] = np.argmin(distances, axis=1)  # the first of equal ones
            error += distances[np.arange(len(x)), codes[:, n]]
        return codes, error

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for b in self.books for x in b.ravel()).encode()).hexdigest()


def integers(vectors: pa.Array, length: int) -> np.ndarray:
    """floor(SCALE * x) of a column of lists, as rows by components."""
    values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * float(SCALE)).reshape(len(vectors), length)
    if values.size and np.abs(values).max() >= 2.0**62:
        return np.array([[int(x) for x in row] for row in values], dtype=object).reshape(values.shape)
    return values.astype(np.int64)


def blocks(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, np.ndarray]]:
    for first in range(0, batch.num_rows, BLOCK):
        yield first, integers(batch.column("vector").slice(first, BLOCK), length)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of ``vectors`` (vec_id, embedding, label): vec_id, label, codes (array of entries), error; and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry has to fit two hex digits")
    spark = vectors.sparkSession
    kept = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    kept = kept.filter(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    by_id = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    least = kept.orderBy(*by_id).select(F.size("vector").alias("n")).limit(1).collect()
    length = least[0].n if least else 0
    if length % parts:
        raise ValueError(f"{parts} equal parts can't be cut from vectors of {length} components")
    kept = kept.filter(F.size("vector") == length)
    width = length // parts
    start = _low(kept, entries).orderBy(*by_id).limit(entries).select("vector").toArrow().column(0).combine_chunks()
    start = integers(start, length)
    books = [start[:, n * width : (n + 1) * width] for n in range(parts)]
    for _ in range(rounds if least else 0):
        books = _moved(kept, books, length)
    shared = spark.sparkContext.broadcast(books)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebooks(shared.value)
        for batch in batches:
            found = [own.assign(block) for _, block in blocks(batch, length)]
            code = np.concatenate([c for c, _ in found]) if found else np.zeros((0, parts), dtype=np.int64)
            error = [int(e) for _, errors in found for e in errors]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code.tolist(), pa.list_(pa.int32())), pa.array(error, pa.int64())], ["vec_id", "label", "codes", "error"])

    kinds = dict(kept.dtypes)
    return kept.mapInArrow(codes, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error bigint"), books


def _low(kept: DataFrame, entries: int) -> DataFrame:
    """Rows that hold the ``entries`` least ids and few others, so that one task can sort them whatever the number of partitions.

    Ids are dealt to ``MINIMA`` groups; the ``entries``-th least of the groups' least ids has at least so many rows up to it."""
    minima = kept.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(MINIMA)).alias("g")).agg(F.min("vec_id").alias("m"))
    minima = sorted(row.m for row in minima.filter("m IS NOT NULL").collect())
    return kept.filter(F.col("vec_id") <= minima[entries - 1]) if len(minima) >= entries else kept


def _moved(kept: DataFrame, books: list[np.ndarray], length: int) -> list[np.ndarray]:
    """The codebooks after one round: each used entry is the floor of the mean of the parts assigned to it."""
    width, shared = books[0].shape[1], kept.sparkSession.sparkContext.broadcast(books)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebooks(shared.value)
        entries = len(own.books[0])
        sums = [np.zeros((entries, width), dtype=object) for _ in own.books]
        counts = np.zeros((len(own.books), entries), dtype=np.int64)
        for batch in batches:
            for _, block in blocks(batch, length):
                codes, _ = own.assign(block)
                for n in range(len(own.books)):
                    counts[n] += np.bincount(codes[:, n], minlength=entries)
                    added = np.zeros((entries, width), dtype=block.dtype)
                    np.add.at(added, codes[:, n], block[:, n * width : (n + 1) * width])
                    sums[n] += added
        part, entry = np.nonzero(counts)
        rows = [[int(x) for x in sums[n][e]] for n, e in zip(part, entry)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry], pa.int64()), pa.array(rows, pa.list_(pa.decimal128(38)))], ["part", "entry", "n", "sums"])

    each = kept.select("vec_id", "label", "vector").mapInArrow(partial, "part int, entry int, n bigint, sums array<decimal(38,0)>")
    totals = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    merged = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect()
    shared.destroy()
    out = [b.copy() for b in books]
    for row in merged:
        means = [int(row[f"s{i}"]) // row.n for i in range(width)]
        if any(abs(m) >= 1 << 62 for m in means):
            out = [b.astype(object) for b in out]
        out[row.part][row.entry] = means
    return out


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` (label, error, ...) with label_error, the error summed over equal labels, nulls together.

    A label's rows are dealt to ``SALTS`` tasks in both the sum and the join."""
    salt = F.pmod(F.xxhash64("vec_id", "error"), F.lit(SALTS)).cast("int")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("label", "__label")
    rows = coded.withColumn("salt", salt)
    return rows.join(sums, (rows.salt == sums.salt) & rows.label.eqNullSafe(F.col("__label"))).drop("salt", "__label")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    coded = with_label_errors(saved(coded, "codes"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(Codebooks(books).digest()).alias("codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB's dialect, by comparing every part with every entry."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"cut AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) t(p))",
        f"book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM cut QUALIFY e < {entries})",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""near{n} AS MATERIALIZED (SELECT vec_id, p, min(struct_pack(d := d, e := e)) AS best FROM (
                SELECT vec_id, cut.p, e, list_sum([(y[1] - y[2]) * (y[1] - y[2]) FOR y IN list_zip(x, c)])::BIGINT AS d FROM cut JOIN book{n} b ON cut.p = b.p) GROUP BY vec_id, p)"""
        )
        if n < rounds:
            steps.append(
                f"""mean{n} AS MATERIALIZED (SELECT p, e, list(m ORDER BY i) AS c FROM (
                    SELECT p, best.e AS e, i, floor(sum(x[i + 1])::DOUBLE / count(*))::BIGINT AS m FROM near{n} JOIN cut USING (vec_id, p), range(len(x)) t(i) GROUP BY ALL) GROUP BY p, e)"""
            )
            steps.append(f"book{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{n}.c, book{n}.c) AS c FROM book{n} LEFT JOIN mean{n} USING (p, e))")
    return f"""WITH {", ".join(steps)},
        coded AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
            (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)"""


ORACLE = _oracle()
