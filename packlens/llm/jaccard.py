"""N-gram Jaccard join: near-duplicate classes of documents by a blocked sparse matrix product.

The incidence matrix has a row per distinct shingle set and a column per shingle. A link needs
100 * overlap >= 80 * union, so a row of n entries needs an overlap of ceil(0.8 n) with any partner.
Each step accumulates counts and discards what stays below such a size-derived bound:

1. Equal sets collapse into one row (documents without words stay alone and link with nothing).
2. Of every row, the n - ceil(0.8 n) + n/4 least entries are dealt out by column; a row whose count
   of columns that another row also has is below the bound of its smallest partner is discarded.
   What is frequent within a batch is counted there, so that a common passage costs each batch one
   entry a column.
3. Over the rows left, exact column counts discard every row with fewer than ceil(0.8 n) columns that
   another row has too, and order the entries of the others from rare to frequent; any two rows that
   link share one of their n - ceil(0.8 n) + 1 rarest. A column's least row is its head. A row belongs
   to the units of its rarest columns' heads, so two rows that share such a column meet in a unit. A
   unit is a head's neighbours and no more: units are not joined to one another.
4. Each unit's product with its transpose accumulates the exact overlaps, block by block: as runs of
   equal columns for small units, row by row over the columns' lists for others, in which rows that
   are already of the same class are masked. Blocks whose sizes cannot reach the bound are never
   paired; what a block pair returns is a forest of its links, at most one edge a row, so a group of
   k near copies never turns into k * k rows.

Classes are the components of these links, every one of which was computed. The union over all blocks
has every link's two ends in one component; none is sampled or capped.
"""

from __future__ import annotations

import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, join_unique, parts, prepare, sieved
from .components import components
from .shingles import mix, shingle_sets

ENTRIES_PER_BUCKET, LEAST_BITS, ROWS_PER_FILE = 1_000_000, 6, 500_000
BLOCK_ROWS, BLOCK_ENTRIES, BIN_ENTRIES = 2048, 1 << 20, 1 << 18
#: Units of so many rows are multiplied together by runs of equal columns.
RUNS = 32


def _need(n, num: int, den: int):
    """The least overlap with any partner of a row of n entries."""
    return (num * n + den - 1) // den


def _slack(n):
    """How many shared entries beyond the first the sampled part of a row is sized for."""
    return np.maximum(1, n // 4)


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return pa.array(batch.column("text")).cast(pa.binary()).to_pylist()


def _prints(sets: list[np.ndarray], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit fingerprints of each set, the first of them by ``salt``."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    at = np.concatenate(([0], np.cumsum(n)))
    out = []
    for seed in (0x51ED270B + 2 * salt, 0x2545F490):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(seed * 0x9E3779B9)), dtype=np.uint64)))
        out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out[0], out[1]


def _stats(k: int, salt: int):
    def run(batches):
        for batch in batches:
            sets = shingle_sets(_texts(batch), k)
            f1, f2 = _prints(sets, salt)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1), pa.array(f2)], names=["id", "n", "f1", "f2"])

    return run


_DEALT = "bucket int, known binary, owners binary, many binary, keys binary"


def _deal(k: int, salt: int, num: int, den: int, bits: int):
    """Sampled entries by bucket of their column; columns met twice in the batch are counted at once."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(_texts(batch), k)
            f1, _ = _prints(sets, salt)
            first = np.unique(f1, return_index=True)[1]
            first = [i for i in first if len(sets[i])]
            if not first:
                continue
            n = np.array([len(sets[i]) for i in first], dtype=np.int64)
            length = n - _need(n, num, den) + _slack(n)
            keys = np.concatenate([sets[i][:m] for i, m in zip(first, length)])
            owner = np.repeat(np.arange(len(first)), length)
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            new = np.concatenate(([True], keys[1:] != keys[:-1]))
            times = np.diff(np.append(np.flatnonzero(new), len(keys)))
            met = np.repeat(times, times) > 1
            credit = np.bincount(owner[met], minlength=len(first)).astype(np.uint32)
            ids = f1[first]
            rows: list[list] = [[], [], [], [], []]

            def put(bucket, known, owners, many, own, rows=rows):
                for column, x in zip(rows, (bucket, known.tobytes(), owners.tobytes(), many.tobytes(), own.tobytes())):
                    column.append(x)

            some = credit > 0
            none = np.zeros(0, np.uint32)
            if some.any():
                put(int(np.bitwise_xor.reduce(ids)) & 0xFFFF | 1 << 30, none, ids[some], credit[some], none)
            known = keys[new][times > 1]
            keys, owner = keys[~met], owner[~met]
            bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            known_bucket = (known >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(known), np.int64)
            low = np.uint64(32 - bits)
            cuts, known_cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1)), np.searchsorted(known_bucket, np.arange((1 << bits) + 1))
            for b in range(1 << bits):
                x, y = slice(cuts[b], cuts[b + 1]), slice(known_cuts[b], known_cuts[b + 1])
                if x.start == x.stop and y.start == y.stop:
                    continue
                by = np.argsort(owner[x], kind="stable")
                who, many = np.unique(owner[x], return_counts=True)
                put(b, (known[y] >> low).astype(np.uint32), ids[who], many.astype(np.uint32), (keys[x][by] >> low).astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(c, pa.binary()) for c in rows[1:])], names=["bucket", "known", "owners", "many", "keys"])

    return run


def _join_bytes(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def _shared(table: pa.Table) -> pa.Table:
    """How many of a row's entries in this bucket are in columns that another row has too."""
    owners, many = _join_bytes(table.column("owners"), np.int64), _join_bytes(table.column("many"), np.uint32)
    if table.column("bucket")[0].as_py() >> 30:
        return _totals(owners, many)
    keys, known = _join_bytes(table.column("keys"), np.uint32), np.unique(_join_bytes(table.column("known"), np.uint32))
    owner = np.repeat(owners, many)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    times = np.diff(np.append(starts, len(keys)))
    hit = np.repeat(np.isin(keys[starts], known, assume_unique=True), times)
    run = np.repeat(np.arange(len(starts)), times)
    again = np.repeat(times > 1, times) & ~hit  # copies of one row in several batches do not count as two
    if again.any():
        r, o = run[again], owner[again]
        by = np.lexsort((o, r))
        fresh = np.concatenate(([True], (r[by][1:] != r[by][:-1]) | (o[by][1:] != o[by][:-1])))
        two = np.bincount(r[by][fresh], minlength=len(starts)) > 1
        hit |= np.repeat(two, times)
    return _totals(owner[hit], np.ones(hit.sum(), np.uint32))


def _totals(owner: np.ndarray, many: np.ndarray) -> pa.Table:
    who, at = np.unique(owner, return_inverse=True)
    return pa.table({"f1": pa.array(who, pa.int64()), "credit": pa.array(np.bincount(at, weights=many, minlength=len(who)).astype(np.int64))})


_BLOCKS = "block long, f1 binary, n binary, keys binary"


def _blocks(k: int, salt: int):
    """Rows of the matrix in blocks; a block's number is drawn once, when the table is written."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(_texts(batch), k)
            f1, _ = _prints(sets, salt)
            at = [i for i in np.unique(f1, return_index=True)[1] if len(sets[i])]
            while at:
                took, size = 0, 0
                while took < len(at) and took < 512 and (not took or size + len(sets[at[took]]) <= 1 << 17):
                    size += len(sets[at[took]])
                    took += 1
                own, at = at[:took], at[took:]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([secrets.randbits(62)], pa.int64()),
                        pa.array([f1[own].tobytes()], pa.binary()),
                        pa.array([np.array([len(sets[i]) for i in own], np.int32).tobytes()], pa.binary()),
                        pa.array([np.concatenate([sets[i] for i in own]).tobytes()], pa.binary()),
                    ],
                    names=["block", "f1", "n", "keys"],
                )

    return run


def _bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """Of sorted keys, where each bucket begins."""
    edges = (np.arange(1, 1 << bits, dtype=np.uint64)) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def _ask(bits: int):
    def run(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("keys").to_pylist()):
                keys, many = np.unique(np.frombuffer(raw, np.uint64), return_counts=True)
                cuts = _bucket_of(keys, bits)
                for b in range(1 << bits):
                    if cuts[b] < cuts[b + 1]:
                        for column, x in zip(rows, (b, block, keys[cuts[b] : cuts[b + 1]].tobytes(), many[cuts[b] : cuts[b + 1]].astype(np.uint32).tobytes())):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())], names=["bucket", "block", "keys", "many"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For the columns each block asks about: 0 where one row has it, else a class that grows with the count."""
    keys, many = _join_bytes(table.column("keys"), np.uint64), _join_bytes(table.column("many"), np.uint32)
    _, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, weights=many)
    rank = np.minimum(255, np.floor(8 * np.log2(total)) + (total > 1)).astype(np.uint8)[at]
    cuts = np.concatenate(([0], np.cumsum([len(x) // 8 for x in table.column("keys").to_pylist()])))
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "ranks": pa.array([rank[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})


def _rarest(num: int, den: int):
    """The rarest columns of each row that has enough columns in common with other rows."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        keys, owners, sizes = [], [], []
        if blocks.num_rows and answers.num_rows:
            order = np.argsort(answers.column("bucket").to_numpy())
            ranks = answers.column("ranks").to_pylist()
            rank_of = np.frombuffer(b"".join(ranks[i] for i in order), np.uint8)
            flat = np.frombuffer(blocks.column("keys")[0].as_py(), np.uint64)
            rank = rank_of[np.unique(flat, return_inverse=True)[1]]
            n = np.frombuffer(blocks.column("n")[0].as_py(), np.int32).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((flat, rank, row))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            enough = np.bincount(row[rank > 0], minlength=len(n)) >= _need(n, num, den)
            take = order[(place <= np.repeat(n - _need(n, num, den), n)) & (rank[order] > 0) & np.repeat(enough, n)]
            keys, owners, sizes = flat[take].view(np.int64), np.frombuffer(blocks.column("f1")[0].as_py(), np.int64)[row[take]], n[row[take]]
        return pa.table({"key": pa.array(keys, pa.int64()), "f1": pa.array(owners, pa.int64()), "n": pa.array(sizes, pa.int64())})

    return run


def _rows(batches):
    """The blocks' rows one by one."""
    for batch in batches:
        for f1, n, keys in zip(*(batch.column(c).to_pylist() for c in ("f1", "n", "keys"))):
            f1, n = np.frombuffer(f1, np.int64), np.frombuffer(n, np.int32)
            at = np.concatenate(([0], np.cumsum(n, dtype=np.int64))) * 8
            yield pa.RecordBatch.from_arrays([pa.array(f1), pa.array([keys[a:b] for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["f1", "keys"])


def run_links(row: np.ndarray, column: np.ndarray, n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The links of a sparse product, from runs of equal columns: entries come as (row, column), ``n`` are
    the rows' sizes. Every run adds one to the overlap of each two of its rows."""
    order = np.lexsort((row, column))
    row, column = row[order], column[order]
    met, step = [], 1
    while step < len(row):
        same = np.flatnonzero(column[step:] == column[:-step])
        if not len(same):
            break
        met.append(row[same] * len(n) + row[same + step])
        step += 1
    code, overlap = np.unique(np.concatenate(met), return_counts=True) if met else (np.zeros(0, np.int64),) * 2
    a, b = code // len(n), code % len(n)
    linked = (a != b) & (overlap * (den + num) >= (n[a] + n[b]) * num)
    return a[linked], b[linked]


def product_labels(sets: list[np.ndarray], num: int = 80, den: int = 100) -> np.ndarray:
    """Of rows given as sorted columns: the least row number of each row's class, from the exact product.

    The product is computed row by row from the lists of the columns, and only for rows that are in no
    class yet: each row of a class is multiplied once with what is still open.
    """
    m = len(sets)
    n = np.array([len(s) for s in sets], dtype=np.int64)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, (old, column) = np.repeat(np.arange(m), n)[shared], np.unique(column[shared], return_inverse=True)
    cuts = np.searchsorted(row, np.arange(m + 1))
    label, is_open = np.full(m, -1, dtype=np.int64), np.ones(m, dtype=bool)

    def lists() -> tuple[np.ndarray, np.ndarray]:
        left = is_open[row]
        by = np.argsort(column[left], kind="stable")
        return row[left][by], np.concatenate(([0], np.cumsum(np.bincount(column[left], minlength=len(old)))))

    rows, starts = lists()
    listed = many = m
    for seed in range(m):
        if not is_open[seed]:
            continue
        label[seed], is_open[seed], todo = seed, False, [seed]
        many -= 1
        while todo and many:
            if 2 * many < listed:
                (rows, starts), listed = lists(), many
            own = todo.pop()
            at = column[cuts[own] : cuts[own + 1]]
            sizes = starts[at + 1] - starts[at]
            if not sizes.sum():
                continue
            place = np.arange(sizes.sum()) + np.repeat(starts[at] - (np.cumsum(sizes) - sizes), sizes)
            overlap = np.bincount(rows[place], minlength=m)
            # den * overlap >= num * union in whole numbers; union = sum of the sizes - overlap
            new = np.flatnonzero(is_open & (overlap * (den + num) >= (n + n[own]) * num))
            label[new], is_open[new] = seed, False
            many -= len(new)
            todo.extend(new.tolist())
    return label


def _edges(num: int, den: int, by: str):
    """A forest of the links in each group of rows."""

    def run(table: pa.Table) -> pa.Table:
        group, f1, raw = table.column(by).to_numpy(), table.column("f1").to_numpy(), table.column("keys").to_pylist()
        order = np.argsort(group, kind="stable")
        a_side, b_side, few = [], [], []
        for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            if 1 < len(own) <= RUNS:
                few.append(own)
            elif len(own) > 1:
                label = product_labels([np.frombuffer(raw[i], np.uint64) for i in own], num, den)
                other = np.flatnonzero(label != np.arange(len(own)))
                a_side.append(f1[own[other]])
                b_side.append(f1[own[label[other]]])
        if few:  # one product for all: the column of a group and a key
            sets = [np.frombuffer(raw[i], np.uint64) for own in few for i in own]
            n = np.array([len(s) for s in sets], dtype=np.int64)
            of = np.repeat(np.arange(len(few)), [len(own) for own in few])
            key = np.concatenate(sets)
            by_key = np.lexsort((key, np.repeat(of, n)))
            new = np.concatenate(([True], (key[by_key][1:] != key[by_key][:-1]) | (np.repeat(of, n)[by_key][1:] != np.repeat(of, n)[by_key][:-1])))
            column = np.empty(len(key), np.int64)
            column[by_key] = np.cumsum(new)
            shared = np.bincount(column)[column] > 1
            a, b = run_links(np.repeat(np.arange(len(sets)), n)[shared], column[shared], n, num, den)
            names = f1[np.concatenate(few)]
            a_side.append(names[a])
            b_side.append(names[b])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(join(a_side), pa.int64()), "b": pa.array(join(b_side), pa.int64())})

    return run


def _pairs(members: DataFrame, num: int, den: int, most_rows: int, most_entries: int) -> DataFrame:
    """Rows of units beyond one block, once for each pair of blocks that could hold a link.

    Blocks are cut by size band (a factor den/num) and, within it, by fingerprint; linked rows are in
    the same or in neighbouring bands.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + 1e-9).cast("int")
    members = members.select("f1", "n", "unit", band.alias("band"))
    bands = members.groupBy("unit", "band").agg(F.count("*").alias("many"), F.ceil(F.greatest(F.count("*") / most_rows, F.sum("n") / most_entries)).cast("int").alias("cuts"))
    cut = bands.select("unit", "band", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    mate = cut.select("unit", F.col("band").alias("band2"), F.col("cut").alias("cut2"))
    pairs = cut.join(mate, "unit").where("band2 - band between 0 and 2 and (band2 > band or cut2 >= cut)")
    pair = F.xxhash64("unit", "band", "cut", "band2", "cut2").alias("pair")
    left = pairs.select("unit", "band", "cut", pair)
    right = pairs.where("band2 <> band or cut2 <> cut").select("unit", F.col("band2").alias("band"), F.col("cut2").alias("cut"), pair)
    placed = join_unique(members, bands, ["unit", "band"], "many").withColumn("cut", F.pmod(F.xxhash64("f1"), F.col("cuts")).cast("int"))
    return placed.join(left.unionAll(right), ["unit", "band", "cut"]).select("pair", "f1")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, most_rows: int = BLOCK_ROWS, most_entries: int = BLOCK_ENTRIES, per_bucket: int = ENTRIES_PER_BUCKET) -> DataFrame:
    """One row a document: id, n (size of its shingle set), set_id, component (least id of its class).

    Two documents link when den * overlap >= num * union of their sets of k-word shingles; classes
    are the components of those links. Documents without words (null or empty text included) have
    n = 0 and are classes of their own. Repeated rows and equal texts are in one class. A null id
    counts as larger than any other. Other columns of ``docs`` are ignored, whatever their names.
    An empty table gives an empty result. Ids must be long. Shingles are 64-bit hashes; sets are told
    apart by 128 bits: a first fingerprint under which two of them fall together is drawn anew.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    salt, clash = -1, True
    while clash:
        salt += 1
        stats = Saved(source.mapInArrow(_stats(k, salt), "id long, n long, f1 long, f2 long"), "stats")
        grouped = stats.df.where("n > 0").groupBy("f1").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("copies"), (F.min("f2") != F.max("f2")).alias("clash"))
        total, many, clash = grouped.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max("clash"), F.lit(False))).first()
    sets = grouped.drop("clash")
    bits = max(LEAST_BITS, (parts(total // 2, per_bucket) - 1).bit_length())

    dealt = source.mapInArrow(_deal(k, salt, num, den, bits), _DEALT)
    credit = dealt.groupBy("bucket").applyInArrow(_shared, "f1 long, credit long").groupBy("f1").agg(F.sum("credit").alias("credit"))
    least = F.expr(f"greatest(1, ({num} * n + {den} - 1) div {den} div 4)")
    rest = Saved(sets.join(credit, "f1").where(F.col("credit") >= least).select("rep", "n"), "rest", parts(many, ROWS_PER_FILE))
    left = rest.df.agg(F.sum("n")).first()[0] or 0
    bits = max(LEAST_BITS, (parts(left, per_bucket) - 1).bit_length())
    reps = rest.df.select("rep").distinct()
    open_rows = sieved(source, F.col("id"), reps, F.col("rep"), many, "open").where("open").select("id", "text")
    blocks = Saved(open_rows.join(reps, open_rows["id"].eqNullSafe(reps["rep"]), "left_semi").mapInArrow(_blocks(k, salt), _BLOCKS), "blocks")

    answers = blocks.df.select("block", "keys").mapInArrow(_ask(bits), "bucket int, block long, keys binary, many binary").groupBy("bucket").applyInArrow(_answer, "block long, bucket int, ranks binary")
    posts = Saved(blocks.df.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_rarest(num, den), "key long, f1 long, n long"), "posts", parts(left, ROWS_PER_FILE))
    heads = posts.df.groupBy("key").agg(F.min("f1").alias("unit"), F.count("*").alias("times")).where("times > 1")
    members = Saved(join_unique(posts.df, heads, ["key"], "times").where("unit is not null").select("f1", "n", "unit").distinct(), "members", parts(left, ROWS_PER_FILE))
    posts.drop()
    sizes = members.df.groupBy("unit").agg(F.count("*").alias("many"), F.sum("n").alias("entries")).where("many > 1")
    placed = join_unique(members.df, sizes, ["unit"], "many").where("many is not null")
    big = (F.col("many") > most_rows) | (F.col("entries") > most_entries)
    rows = Saved(blocks.df.mapInArrow(_rows, "f1 long, keys binary").join(members.df.select("f1").distinct(), "f1", "left_semi"), "rows", parts(left, ROWS_PER_FILE))
    in_small, any_large = sizes.agg(F.sum(F.when(~big, F.col("entries"))), F.max(big)).first()
    bins = parts(in_small, BIN_ENTRIES)
    small = placed.where(~big).select("f1", "unit", F.pmod(F.xxhash64("unit"), F.lit(bins)).alias("bin")).join(rows.df, "f1")
    # by stated number: a bin's work is not in proportion to its bytes, so that bins should not be merged by size
    edges = small.repartition(bins, "bin").groupBy("bin").applyInArrow(_edges(num, den, "unit"), "a long, b long")
    if any_large:
        pairs = _pairs(placed.where(big), num, den, most_rows, most_entries).join(rows.df, "f1")
        edges = edges.unionAll(pairs.groupBy("pair").applyInArrow(_edges(num, den, "pair"), "a long, b long"))
    linked = components(edges)
    for done in (rows, members, blocks):
        done.drop()

    classes = sets.join(linked.select(F.col("node").alias("f1"), "root"), "f1", "left").select("f1", "rep", "copies", F.coalesce("root", "f1").alias("root"))
    least_id = classes.groupBy("root").agg(F.min("rep").alias("component"), F.count("*").alias("sets"))
    named = join_unique(classes, least_id, ["root"], "sets", many).select("f1", "copies", "component")
    out = join_unique(stats.df.where("n > 0").select("id", "n", "f1"), named, ["f1"], "copies", weights=sets).select("id", "n", F.col("f1").alias("set_id"), "component")
    return out.unionByName(stats.df.where("n = 0").select("id", "n", F.lit(None).cast("long").alias("set_id"), F.col("id").alias("component")))


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; see near_duplicates."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
