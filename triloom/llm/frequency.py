"""Frequencies of distinct terms over a vertical layout: one compressed bitmap of record numbers for each term.

Layout. A record number is 64 bits; its upper 48 name a chunk, its lower 16 the place in it. A term's set of records is
kept as one container for each chunk: a sorted array of 16-bit places below 4096 members, a bitmap of 8 KB from there.
Containers are built next to the scan, where each task sees every term of its rows once, and carry the occurrences
counted beside them. They are then united by (term, chunk), so that a term that occurs everywhere is spread over as many
tasks as there are chunks, and a task holds a single container at a time. Document frequency is the cardinality.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.session import arrow, col, cut

ARRAY_LIMIT = 4096
BITMAP_BYTES = 8192
#: Values that a task gathers before it turns them into containers; bounds its memory.
FLUSH = 1_000_000


def term_frequency(df: DataFrame, record: str, slots: Sequence[str], empty: bool = True, rare: int = 2, common: int = 4) -> DataFrame:
    """For each distinct value of ``slots``: occurrences, records, and a mark.

    All slots count as one field. Values are compared exactly; nulls are left out, and empty strings too unless
    ``empty``. A repeated row adds occurrences, not records. Rows without a record are left out. ``mark`` is ``rare`` if
    the term is in at most ``rare`` records, ``common`` if ``common`` times its records exceed all records of ``df``
    (rare goes first), else null. Columns: term, n_occurrences, n_records, mark. An empty table gives no rows.
    """
    used = df.select(col(df, record).cast("string").alias("rec"), *[col(df, s).cast("string").alias(f"s{i}") for i, s in enumerate(slots)]).where("rec is not null")
    # numbers are dense within each part of this table; it is written once, as numbers must not change between attempts
    numbers = cut(used.select("rec").distinct().withColumn("no", F.monotonically_increasing_id()), "records")
    bags = used.transform(arrow, _bags(empty), "rec string, terms array<string>, counts array<int>")
    built = bags.join(numbers, "rec").select("no", "terms", "counts").transform(arrow, _build, "term string, chunk long, members binary, occ long")
    united = built.repartition("term", "chunk").sortWithinPartitions("term", "chunk").transform(arrow, _unite, "term string, n_records long, n_occurrences long")
    terms = united.groupBy("term").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))
    total = numbers.count()
    return terms.withColumn("mark", F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") * common > total, "common"))


def _bags(empty: bool):
    """Rows next to each other that belong to one record become one row with the record's distinct terms and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, 200_000):
            recs = pc.dictionary_encode(batch.column(0)).unify_dictionaries().combine_chunks()
            recs = recs.chunk(0) if isinstance(recs, pa.ChunkedArray) else recs
            slots = [batch.column(i).combine_chunks() for i in range(1, batch.num_columns)]
            rec = np.tile(recs.indices.to_numpy(), len(slots))
            values = pa.concat_arrays([x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks) for x in slots])
            keep = pc.is_valid(values)
            if not empty:
                keep = pc.and_(keep, pc.not_equal(pc.fill_null(values, ""), ""))
            values, rec = values.filter(keep), rec[np.asarray(keep)]
            if not len(values):
                continue
            coded = values.dictionary_encode()
            n_terms = len(coded.dictionary)
            pairs, counts = np.unique(rec.astype(np.int64) * n_terms + coded.indices.to_numpy(), return_counts=True)
            rec, term = pairs // n_terms, pairs % n_terms
            starts = np.flatnonzero(np.r_[True, rec[1:] != rec[:-1]])
            offsets = pa.array(np.r_[starts, len(rec)].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [recs.dictionary.take(pa.array(rec[starts])), pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(term))), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32)))],
                ["rec", "terms", "counts"],
            )

    return run


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += len(batch.column(1).flatten())
        if n >= FLUSH:
            yield from _containers(held)
            held, n = [], 0
    if n:
        yield from _containers(held)


def _containers(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    values = pa.concat_arrays([b.column(1).flatten() for b in held])
    counts = np.concatenate([b.column(2).flatten().to_numpy() for b in held])
    no = np.concatenate([np.repeat(b.column(0).to_numpy(), np.asarray(pc.list_value_length(b.column(1)))) for b in held])
    coded = values.dictionary_encode()
    term = coded.indices.to_numpy().astype(np.int64)
    occ = np.bincount(term, weights=counts, minlength=len(coded.dictionary)).astype(np.int64)
    order = np.lexsort((no, term))
    term, no = term[order], no[order]
    new = np.r_[True, (term[1:] != term[:-1]) | (no[1:] != no[:-1])]  # a record may come in several rows
    term, no = term[new], no[new]
    first = np.r_[True, term[1:] != term[:-1]]
    chunk = no >> 16
    starts = np.flatnonzero(first | np.r_[True, chunk[1:] != chunk[:-1]])
    members = _encode((no & 0xFFFF).astype(np.uint16), np.r_[starts, len(no)])
    occ = np.where(first[starts], occ[term[starts]], 0)
    table = pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(term[starts])), pa.array(chunk[starts]), members, pa.array(occ)], ["term", "chunk", "members", "occ"])
    for i in range(0, table.num_rows, 50_000):
        yield table.slice(i, 50_000)


def _encode(places: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Containers from sorted 16-bit places; container i holds places[bounds[i]:bounds[i + 1]]."""
    sizes = np.diff(bounds)
    if (sizes < ARRAY_LIMIT).all():
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((bounds * 2).astype(np.int32).tobytes()), pa.py_buffer(places.astype("<u2").tobytes())])
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a < ARRAY_LIMIT:
            out.append(places[a:b].astype("<u2").tobytes())
        else:
            bits = np.zeros(1 << 16, np.uint8)
            bits[places[a:b]] = 1
            out.append(np.packbits(bits).tobytes())
    return pa.array(out, pa.binary())


def _decode(members: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(container, place) of every member."""
    sizes = np.asarray(pc.binary_length(members))
    wide = sizes == BITMAP_BYTES
    narrow = members.filter(pa.array(~wide))
    group = np.repeat(np.flatnonzero(~wide), sizes[~wide] // 2)
    place = np.frombuffer(b"".join(narrow.to_pylist()), "<u2").astype(np.int64)
    for i in np.flatnonzero(wide):
        on = np.flatnonzero(np.unpackbits(np.frombuffer(members[int(i)].as_py(), np.uint8)))
        group, place = np.r_[group, np.full(len(on), i)], np.r_[place, on]
    return group, place


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (term, chunk); the last group of a batch is carried over as one united container."""
    names = ["term", "chunk", "members", "occ"]
    rest: pa.RecordBatch | None = None
    for batch in batches:
        batch = pa.RecordBatch.from_arrays([batch.column(i).cast(t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.int64()))], names)
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        coded = batch.column(0).dictionary_encode().indices.to_numpy()
        chunk = batch.column(1).to_numpy()
        starts = np.flatnonzero(np.r_[True, (coded[1:] != coded[:-1]) | (chunk[1:] != chunk[:-1])])
        last = starts[-1]
        occ = np.add.reduceat(batch.column(3).to_numpy(), starts)
        lengths = np.diff(np.r_[starts, batch.num_rows])
        # groups of one row need no union; the others are decoded together
        cards = np.zeros(len(starts), np.int64)
        sizes = np.asarray(pc.binary_length(batch.column(2)))
        alone = lengths == 1
        plain = alone & (sizes[starts] < BITMAP_BYTES)
        cards[plain] = sizes[starts[plain]] // 2
        many = np.repeat(~plain, lengths)
        many[last:] = True
        ids = np.repeat(np.arange(len(starts)), lengths)[many]
        group, place = _decode(batch.column(2).filter(pa.array(many)))
        both = np.unique((ids[group] << 16) | place)
        got, n = np.unique(both >> 16, return_counts=True)
        cards[got] = n
        tail = (both[both >> 16 == len(starts) - 1] & 0xFFFF).astype(np.uint16)
        rest = pa.RecordBatch.from_arrays([batch.column(0).slice(last, 1), batch.column(1).slice(last, 1), _encode(tail, np.array([0, len(tail)])), pa.array(occ[-1:])], names)
        if len(starts) > 1:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts[:-1])), pa.array(cards[:-1]), pa.array(occ[:-1])], ["term", "n_records", "n_occurrences"])
    if rest is not None:
        yield pa.RecordBatch.from_arrays([rest.column(0), pa.array([len(_decode(rest.column(2))[1])], pa.int64()), rest.column(3)], ["term", "n_records", "n_occurrences"])
