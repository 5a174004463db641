"""Pairs of items that stand in the same record, counted within a group, and how much oftener than by chance.

A record's items are a set. Every item of a group has a 32-bit number: HASH_BITS of its hash, then its rank among the
group's items of the same hash, so that no two share a number. A pair is one 64-bit code of two numbers, in the order of
the items; an item and a record are codes with NONE for what is missing.

1. The group's items are gathered by hash, which gives their ranks: the dictionary. Nearly all ranks are 0, so numbers
   are computed where the records are; the few others are broadcast, or joined if they are more than ``CLASH_ROWS``.
2. External sort of the codes: a task fills a run of at most ``RUN_CODES`` codes, sorts it, counts equal ones, and hands
   it over, however many items one record has; records of more than ``SPLIT_ITEMS`` are paired out by several tasks.
   The exchange takes (group, code, count), and its sort spills sorted runs and merges them. Equal codes then stand
   next to each other and are counted as runs. A frequent pair arrives pre-aggregated, one row a run.
3. Codes become items again, by the dictionary, when rare pairs are gone.

A record of m items has m(m-1)/2 pairs; that is the question asked. Records, not groups, are paired out.

Odds ratios use 0.5 added to all four cells (continuity correction), so that empty cells give finite values.

Defined results: records without items count as records; null and blank items are none; repeated items of a record
count once; records of a null group give nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import analysis_json as aj
from quire.plans.session import shuffle_width, written

RUN_CODES = 1 << 21
#: Records of more items are divided among tasks, in slices of about RUN_CODES pairs.
SPLIT_ITEMS = 2048
#: Bits of a number that are hash; the others are the rank among items of the same hash.
HASH_BITS = 27
NONE = (1 << 32) - 1
#: Items of a rank above 0 that are broadcast at most.
CLASH_ROWS = 100_000
_RUN = pa.schema([("grp", pa.string()), ("code", pa.int64()), ("n", pa.int64())])
_RUN_SCHEMA = "grp string, code bigint, n bigint"


def participant_records(df: DataFrame) -> DataFrame:
    """grp, items (array<array<string>>) of chunk analyses: one array an interaction, of its distinct named participants. Each chunk_id counts once; should its rows differ, the greatest array counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                root = aj.as_object(aj.load(text))
                if root is None:
                    out.append(None)
                    continue
                records = [x for x in aj.elements(root.get("relationships_interactions")) if x is not None]
                out.append([sorted({n for p in aj.member(x, "participants") if (n := aj.name_of(p)) is not None}) for x in records])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.list_(pa.string())))], names=["grp", "chunk_id", "items"])

    read = df.where("analysis_status = 'success' and chunk_id is not null and document_id is not null and analysis is not null")
    rows = read.select("document_id", "chunk_id", "analysis").mapInArrow(run, "grp string, chunk_id string, items array<array<string>>")
    return rows.where("items is not null").groupBy("grp", "chunk_id").agg(F.max("items").alias("items")).select("grp", "items")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of counted codes from (grp, ids, from, to): the pairs of the ids from..to with those after them; from 0 also the ids and the record. Holds at most RUN_CODES codes and those of one id."""
    groups: dict[str, int] = {}
    small: list[int] = []
    owner: list[int] = []
    large: list[tuple[int, np.ndarray]] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal groups, small, owner, large, held
        names = list(groups)
        codes = np.concatenate([np.array(small, np.uint64), *(c for _, c in large)])
        whose = np.concatenate([np.array(owner, np.int64), *(np.full(len(c), g) for g, c in large)])
        order = np.lexsort((codes, whose))
        codes, whose = codes[order], whose[order]
        first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (whose[1:] != whose[:-1])])) if len(codes) else np.empty(0, np.int64)
        count = np.diff(np.concatenate([first, [len(codes)]]))
        grp = pa.DictionaryArray.from_arrays(pa.array(whose[first], pa.int32()), pa.array(names, pa.string())).cast(pa.string())
        out = pa.RecordBatch.from_arrays([grp, pa.array(codes[first].view(np.int64)), pa.array(count, pa.int64())], schema=_RUN)
        groups, small, owner, large, held = {}, [], [], [], 0
        return out

    for batch in batches:
        for grp, ids, low, high in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            own = groups.setdefault(grp, len(groups))
            before = len(small)
            if low == 0:
                small.append(NONE << 32 | NONE)
            if len(ids) <= 64 and low == 0 and high >= len(ids):
                small += [i << 32 | NONE for i in ids]
                small += [i << 32 | j for k, i in enumerate(ids) for j in ids[k + 1 :]]
            else:
                every = np.array(ids, np.uint64)
                for k in range(low, min(high, len(ids))):
                    large.append((own, every[k] << np.uint64(32) | np.append(every[k + 1 :], np.uint64(NONE))))
                    held += len(ids) - k
                    if held >= RUN_CODES:
                        owner += [own] * (len(small) - before)
                        yield flush()
                        own, before = groups.setdefault(grp, len(groups)), 0
            owner += [own] * (len(small) - before)
            held += len(small) - before
            if held >= RUN_CODES:
                yield flush()
    yield flush()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length counts of rows that are sorted by group and code."""
    last: tuple[str, int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        grp = batch.column(0).dictionary_encode()
        whose, codes, counts = grp.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (whose[1:] != whose[:-1])]))
        sums = np.add.reduceat(counts, first)
        names, keys, sums = grp.dictionary.take(pa.array(whose[first])).to_pylist(), codes[first].tolist(), sums.tolist()
        if last is not None and (names[0], keys[0]) == last[:2]:
            sums[0] += last[2]
        elif last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(last, _RUN, strict=True)], schema=_RUN)
        last = (names[-1], keys[-1], sums[-1])
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1], f.type) for c, f in zip((names, keys, sums), _RUN, strict=True)], schema=_RUN)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(last, _RUN, strict=True)], schema=_RUN)


def _hash(grp: F.Column, item: F.Column) -> F.Column:
    return F.xxhash64(grp, item).bitwiseAND((1 << HASH_BITS) - 1)


def dictionary_of(records: DataFrame) -> DataFrame:
    """grp, item, number of all items of records (grp, items); written."""
    each = records.select("grp", F.explode("items").alias("item"))
    by = each.groupBy("grp", _hash(F.col("grp"), F.col("item")).alias("hash")).agg(F.sort_array(F.collect_set("item")).alias("held"))
    ranks = 1 << (32 - HASH_BITS)
    fits = F.when(F.size("held") < ranks, F.col("held")).otherwise(F.raise_error(F.lit(f"a group has {ranks} or more items of one hash of {HASH_BITS} bits")))
    ranked = by.select("grp", "hash", F.posexplode(fits).alias("rank", "item"))
    return written(ranked.select("grp", "item", (F.col("hash") * ranks + F.col("rank")).alias("number"), "rank"))


def _numbered(records: DataFrame, dictionary: DataFrame) -> DataFrame:
    """grp, ids: the numbers of each record's items, in the order of the items."""
    clashes = dictionary.where("rank > 0").select("grp", "item", "rank")
    count = clashes.count()
    ranks = 1 << (32 - HASH_BITS)
    if count > CLASH_ROWS:
        each = records.withColumn("record", F.monotonically_increasing_id()).select("record", "grp", F.posexplode_outer("items").alias("at", "item"))
        joined = each.join(dictionary.select("grp", "item", "number"), ["grp", "item"], "left")
        return joined.groupBy("record", "grp").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("at", "number")))), lambda x: x["number"]).alias("ids")).select("grp", "ids")
    number = lambda x: _hash(F.col("grp"), x) * ranks
    if not count:
        return records.select("grp", F.transform("items", number).alias("ids"))
    known = clashes.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("item", "rank"))).alias("clash"))
    return records.join(F.broadcast(known), "grp", "left").select("grp", F.transform("items", lambda x: number(x) + F.coalesce(F.element_at("clash", x), F.lit(0))).alias("ids"))


def code_counts(records: DataFrame, dictionary: DataFrame) -> DataFrame:
    """grp, code, n of every pair, item and record of records (grp, items: distinct and sorted)."""
    width = shuffle_width(records.sparkSession)
    numbered = _numbered(records, dictionary)
    size = F.size("ids")
    whole = numbered.where(size <= SPLIT_ITEMS).select("grp", "ids", F.lit(0).alias("low"), size.alias("high"))
    step = F.greatest(F.lit(1), F.floor(F.lit(RUN_CODES) / size)).cast("int")
    sliced = numbered.where(size > SPLIT_ITEMS).select("grp", "ids", F.explode(F.sequence(F.lit(0), size - 1, step)).alias("low"), step.alias("step"))
    parts = sliced.select("grp", "ids", "low", (F.col("low") + F.col("step")).alias("high")).repartition(width, "grp", "low", F.xxhash64("ids"))
    runs = whole.unionByName(parts).mapInArrow(_runs, _RUN_SCHEMA)
    return runs.repartition(width, "grp", "code").sortWithinPartitions("grp", "code").mapInArrow(_merged, _RUN_SCHEMA)


def pair_counts(records: DataFrame, *, least: int = 1) -> DataFrame:
    """grp, a, b, n_ab, n_a, n_b, n, lift, odds_ratio of pairs that stand together at least ``least`` times; a < b. records: grp, items (array<array<string>>), each array a record."""
    each = records.where("grp is not null and items is not null").select("grp", F.explode("items").alias("items"))
    clean = F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull() & x.rlike(r"\S"))))
    single = written(each.select("grp", F.coalesce(clean, F.array().cast("array<string>")).alias("items")))
    dictionary = dictionary_of(single)
    counts = written(code_counts(single, dictionary))
    left, right = F.shiftrightunsigned("code", 32), F.col("code").bitwiseAND(NONE)
    split = counts.select("grp", left.alias("left"), right.alias("right"), "n")
    total = split.where(F.col("left") == NONE).select("grp", "n")
    items = written(split.where((F.col("left") != NONE) & (F.col("right") == NONE) & (F.col("n") >= least)).join(dictionary.select("grp", "item", F.col("number").alias("left")), ["grp", "left"]).select("grp", F.col("left").alias("number"), "item", "n"))
    pairs = split.where((F.col("right") != NONE) & (F.col("n") >= least)).select("grp", "left", "right", F.col("n").alias("n_ab"))
    one = items.select("grp", F.col("number").alias("left"), F.col("item").alias("a"), F.col("n").alias("n_a"))
    two = items.select("grp", F.col("number").alias("right"), F.col("item").alias("b"), F.col("n").alias("n_b"))
    all_ = pairs.join(one, ["grp", "left"]).join(two, ["grp", "right"]).join(total, "grp")
    x, a, b, n = (F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n"))
    odds = ((x + 0.5) * (n - a - b + x + 0.5)) / ((a - x + 0.5) * (b - x + 0.5))
    return all_.select("grp", "a", "b", "n_ab", "n_a", "n_b", "n", (x * n / (a * b)).alias("lift"), odds.alias("odds_ratio"))
