"""Repeated passages by suffix arrays: removes every byte inside a string of LENGTH bytes that also
starts somewhere else.

A whole corpus has too many suffixes to sort at once, and all but a few begin nothing that is repeated.
So each window names the least hash among the GRAM-byte strings in it as its anchor; a window is
LENGTH bytes or WORDS words, whichever is shorter. Equal strings of LENGTH bytes, and equal strings of
WORDS words, have equal anchors. Windows whose anchor occurs at one place only are unique and go no
further. The others are dealt out by anchor: equal windows meet in one bucket, each in exactly one.

A bucket's windows are suffixes of its fragments, sorted in two stages: suffixes smaller than their
successors directly, by their bytes; the rest by scanning the buckets of first bytes in order, each
entry placing its predecessor. Adjacent common prefixes of LENGTH or more are repeats, which are removed;
those of WORDS whole words between two documents are passages, which are reported. They are computed only where a suffix does not stand right behind the neighbour of the one before it, or where the
one before shares nothing with its neighbour; elsewhere they are one less than the last.

Texts that are equal as a whole are one text with a multiplicity; fragments that are equal are sorted
once, with a list of their owners.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, join_unique, parts, prepare
from .shingles import _BASE, _BYTE, _INVERSE, _SPACE, _power, mix

LENGTH, WORDS, GRAM, BUCKET_BYTES, BLOCK_BYTES, SEGMENT = 400, 51, 64, 8 << 20, 1 << 20, 1 << 22
_LOW = np.uint64((1 << 24) - 1)


def window_ends(raw: np.ndarray, ends: np.ndarray, length: int, words: int) -> np.ndarray:
    """For every place of texts put one after the other: where its window ends, LENGTH bytes on or behind
    the WORDS-th word, counted from the word the place is in or before; 0 where its text ends before."""
    n = len(raw)
    inside = ~_SPACE[raw]
    last = inside.copy()  # the last byte of a word
    last[:-1] &= ~inside[1:]
    at_end = ends[ends > 0] - 1
    last[at_end] = inside[at_end]
    word_ends = np.append(np.flatnonzero(last) + 1, np.full(words, 1 << 60))
    ended = np.cumsum(last) - last  # words that end before this place
    text_end = np.repeat(ends, np.diff(np.concatenate(([0], ends))))
    stop = np.minimum(np.arange(length, n + length), word_ends[ended + (words - 1)])
    return np.where(stop <= text_end, stop, 0)


def _least(key: np.ndarray, first: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """The least of ``wide`` values of ``key`` from each of ``first`` on: two overlapping powers of two."""
    out = np.empty(len(first), key.dtype)
    now, span = key, 1
    low, high = (wide.min(), wide.max()) if len(wide) else (0, 0)
    while len(first):
        if 2 * span > low:
            here = np.flatnonzero((wide >= span) & (wide < 2 * span))
            out[here] = np.minimum(now[first[here]], now[first[here] + wide[here] - span])
        if 2 * span > high:
            break
        now, span = np.minimum(now[:-span], now[span:]), span * 2
    return out


def _anchors(raw: np.ndarray, ends: np.ndarray, length: int, gram: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The window starts of the texts in ``raw``, their anchors' places, and the hashes of all grams."""
    n = len(raw)
    stop = window_ends(raw, ends, length, words)
    starts = np.flatnonzero(stop)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * _power(_BASE, n), out=total[1:])
    hashes = mix((total[gram:] - total[: n - gram + 1]) * _power(_INVERSE, n)[: n - gram + 1])
    key = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    return starts, (_least(key, starts, stop[starts] - starts - (gram - 1)) & _LOW).astype(np.int64), hashes


def anchor_runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, words: int = WORDS) -> tuple[np.ndarray, ...]:
    """text number, first window start, number of windows, anchor place and anchor hash of every run of
    consecutive windows with one anchor. Texts shorter than a window have none."""
    least = min(length, 2 * words - 1)
    out: list[list] = [[], [], [], [], []]

    def put(raw: np.ndarray, ends: np.ndarray, numbers: list[int], offset: int, limit: int | None) -> None:
        if len(raw) < least:
            return
        starts, at, hashes = _anchors(raw, ends, length, gram, words)
        if limit is not None:
            starts, at = starts[starts < limit], at[starts < limit]
        text = np.searchsorted(ends, starts, side="right")
        if not len(starts):
            return
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (starts[1:] != starts[:-1] + 1)))
        head = np.flatnonzero(new)
        own = text[head]
        base = np.concatenate(([0], ends))[own] - offset
        for column, x in zip(out, (np.array(numbers)[own], starts[head] - base, np.diff(np.append(head, len(starts))), at[head] - base, hashes[at[head]])):
            column.append(x)

    block, numbers, size = [], [], 0

    def flush() -> None:
        nonlocal block, numbers, size
        if block:
            put(np.frombuffer(b"".join(block), np.uint8), np.cumsum([len(t) for t in block]), numbers, 0, None)
        block, numbers, size = [], [], 0

    for i, text in enumerate(texts):
        if len(text) < least:
            continue
        if len(text) > SEGMENT:
            for a in range(0, len(text) - least + 1, SEGMENT):
                part = np.frombuffer(text, np.uint8)[a : a + SEGMENT + length]
                put(part, np.array([len(part)]), [i], a, SEGMENT)
            continue
        if size + len(text) > SEGMENT // 16:
            flush()
        block.append(text)
        numbers.append(i)
        size += len(text)
    flush()
    kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64)
    return tuple(np.concatenate(c).astype(k) if c else np.zeros(0, k) for c, k in zip(out, kinds))


def two_stage_order(text: bytes, ends: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The suffixes of a text of fragments, in order. ``ends`` are the fragments' ends; a suffix ends
    with its fragment, before any longer one. ``wanted`` marks the suffixes asked for; of each
    fragment they are a first part. Returned are they and the few behind them that induction needs."""
    n = len(text)
    raw = np.frombuffer(text, np.uint8)
    value = raw.astype(np.int16) + 1
    after = np.zeros(n, np.int16)
    after[:-1] = value[1:]
    after[ends - 1] = 0  # a fragment's end is less than any byte
    # smaller than the successor: at the next place where neighbours differ, the left one is less
    differ = np.flatnonzero(value != after)
    nxt = differ[np.searchsorted(differ, np.arange(n))]
    small = value[nxt] < after[nxt]
    # each wanted suffix not smaller than its successor is induced from it, down to the next small one or the end
    first_small = np.concatenate((np.flatnonzero(small), [n]))
    last = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
    fragment_end = ends[np.searchsorted(ends, last, side="right")]
    stop = np.minimum(first_small[np.searchsorted(first_small, last)], fragment_end - 1)
    member = np.zeros(n + 1, np.int32)
    np.add.at(member, last, 1)
    np.add.at(member, stop + 1, -1)
    member = wanted | (np.cumsum(member[:-1]) > 0)
    end_of = lambda x: ends[np.searchsorted(ends, x, side="right")]
    direct = np.flatnonzero(member & small)
    pad = np.concatenate((raw, np.zeros(8, np.uint8)))
    stops = end_of(direct)
    key = np.zeros(len(direct), np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | np.where(direct + i < stops, pad[direct + i], 0).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    direct, stops, key = direct[order], stops[order], key[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else np.zeros(1, int)
    for a, b in zip(new[:-1][np.diff(new) > 1], new[1:][np.diff(new) > 1]):
        held = sorted(zip([text[i:e] for i, e in zip(direct[a:b].tolist(), stops[a:b].tolist())], direct[a:b].tolist()))
        direct[a:b] = [i for _, i in held]
    # scan the buckets of first bytes: what is induced comes before what was sorted
    large = member & ~small
    queues: list[list[np.ndarray]] = [[] for _ in range(257)]
    tails = ends[large[ends - 1]] - 1  # induced from the empty suffix at their fragment's end
    cuts = np.searchsorted(value[direct], np.arange(259))

    def hand_on(entries: np.ndarray, now: int) -> np.ndarray:
        before = entries[entries > 0] - 1
        before = before[large[before]]
        before = before[after[before] != 0]
        first = value[before]
        same, later = before[first == now], before[first != now]
        if len(later):
            by = np.argsort(value[later], kind="stable")
            later = later[by]
            at = np.flatnonzero(np.concatenate(([True], value[later][1:] != value[later][:-1], [True])))
            for a, b in zip(at[:-1], at[1:]):
                queues[value[later[a]]].append(later[a:b])
        return same

    by = np.argsort(value[tails], kind="stable")
    for i in tails[by]:
        queues[value[i]].append(np.array([i]))
    out = []
    for now in range(1, 257):
        entries = np.concatenate(queues[now]) if queues[now] else np.zeros(0, np.int64)
        while len(entries):
            out.append(entries)
            entries = hand_on(entries, now)
        entries = direct[cuts[now] : cuts[now + 1]]
        if len(entries):
            out.append(entries)
            hand_on(entries, now)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def repeated_starts(fragments: list[bytes], windows: list[int], twice: np.ndarray, owner: np.ndarray, at_word: np.ndarray, length: int = LENGTH, words: int = WORDS) -> tuple[list[np.ndarray], np.ndarray]:
    """Two things of the first ``windows`` places of each fragment: which of them begin a string of
    ``length`` bytes that begins at another of these places too; and whether another owner's fragment
    has such a string as well, or the window that begins with a word at one of them.

    ``twice`` marks fragments that stand for several equal ones; ``owner`` numbers the text a fragment is
    from, below 0 if it is from several; ``at_word`` says whether no word runs into its first byte.
    """
    text = b"".join(fragments)
    ends = np.cumsum([len(f) for f in fragments])
    begins = ends - [len(f) for f in fragments]
    many = np.array(windows)
    wanted = np.zeros(len(text) + 1, np.int32)
    np.add.at(wanted, begins, 1)
    np.add.at(wanted, begins + many, -1)
    wanted = np.cumsum(wanted[:-1]) > 0
    order = two_stage_order(text, ends, wanted)
    order = order[wanted[order]]
    # what stands before each suffix in the order; its common prefix with it, of which only enough or not counts
    left = np.full(len(text), -1, dtype=np.int64)
    left[order[1:]] = order[:-1]
    places = np.flatnonzero(wanted)
    prior = left[places]
    head = np.concatenate(([True], (places[1:] != places[:-1] + 1) | (prior[1:] != prior[:-1] + 1) | (prior[1:] < 0) | (prior[:-1] < 0)))
    end = ends[np.searchsorted(ends, places, side="right")]
    prior_end = ends[np.minimum(np.searchsorted(ends, np.maximum(prior, 0), side="right"), len(ends) - 1)]
    room = np.minimum(end - places, prior_end - prior)
    lcp = np.full(len(places), -1, dtype=np.int64)
    common = np.zeros(len(places), dtype=np.int64)
    fresh = head
    while fresh.any():
        for k in np.flatnonzero(fresh & (prior >= 0)).tolist():
            common[k] = _common(text, int(places[k]), int(prior[k]), int(room[k]))
        at = np.flatnonzero(head)
        run = np.cumsum(head) - 1
        lcp = common[at][run] - (places - places[at][run])
        # behind a prefix of nothing, the next two suffixes may agree again: they are compared anew
        fresh = lcp == -1
        head = head | fresh
    long = np.zeros(len(text) + 1, dtype=bool)
    hit = (lcp >= length) & (prior >= 0)
    long[places[hit]] = True
    long[prior[hit]] = True
    sure = end - places >= length
    number = np.searchsorted(ends, places, side="right")
    long[places[sure & twice[number]]] = True

    raw = np.frombuffer(text, np.uint8)
    wide = window_ends(raw, ends, length, words)
    wide = np.where(wide > 0, wide - np.arange(len(raw)), 0)
    blank = _SPACE[raw]
    starts = ~blank
    starts[1:] &= blank[:-1]
    starts[begins] = at_word & ~blank[begins]
    of = np.searchsorted(ends, order, side="right")
    by_order = np.full(len(text), -1, dtype=np.int64)
    by_order[places] = lcp
    by_order = by_order[order]
    # windows that are equal: neighbours among those of one size, with no less in common all the way between
    some = np.flatnonzero((wanted & (wide > 0) & starts)[order])
    some = some[np.argsort(wide[order[some]], kind="stable")]
    size = wide[order[some]]
    one = np.flatnonzero(size[1:] == size[:-1])
    a, b = some[:-1][one], some[1:][one]
    same = _least(by_order, a + 1, b - a) >= size[one]
    long_ones = np.flatnonzero(by_order >= length)
    p, q = of[np.concatenate((a[same], long_ones - 1))], of[np.concatenate((b[same], long_ones))]
    met = (owner[p] != owner[q]) | (owner[p] < 0)
    passage = np.zeros(len(fragments), dtype=bool)
    passage[p[met]] = True
    passage[q[met]] = True
    for shared in (of[some], number[sure]):  # what several texts have as a whole
        passage[shared[owner[shared] < 0]] = True
    return [long[a : a + m] for a, m in zip(begins.tolist(), windows)], passage


def _common(text: bytes, i: int, j: int, most: int) -> int:
    """The length of the common prefix of two suffixes, ``most`` at the most: doubling, then halving."""
    if text[i : i + most] == text[j : j + most]:
        return most
    low, step = 0, 16
    while low + step <= most and text[i + low : i + low + step] == text[j + low : j + low + step]:
        low += step
        step *= 2
    high = min(most, low + step)
    while high - low > 1:
        mid = (low + high) // 2
        if text[i + low : i + mid] == text[j + low : j + mid]:
            low = mid
        else:
            high = mid
    return low + (low < most and text[i + low : i + low + 1] == text[j + low : j + low + 1])


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: What a row of anchors says: one occurrence; that an anchor occurs twice; an occurrence of such a one.
_ONCE, _AGAIN, _SETTLED = 0, 1, 2


def _find_anchors(length: int, gram: int, words: int):
    """Occurrences of anchors. Those met twice in a batch are settled there: what travels on by anchor is
    one row a batch, however often a line or passage occurs."""

    def run(batches):
        for batch in batches:
            content, seen = batch.column("content").to_numpy(), set()
            texts = [b"" if c in seen or seen.add(c) else t for c, t in zip(content.tolist(), batch.column("text").cast(pa.binary()).to_pylist())]
            number, _, _, place, hashes = anchor_runs(texts, length, gram, words)
            order = np.argsort(hashes, kind="stable")
            hashes, number, place = hashes[order], number[order], place[order]
            new = np.concatenate(([True], hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, bool)
            times = np.diff(np.append(np.flatnonzero(new), len(hashes)))
            settled = np.repeat(times > 1, times)
            heads = np.flatnonzero(new)[times > 1]
            at = np.concatenate((np.arange(len(hashes)), heads))
            kind = np.concatenate((np.where(settled, _SETTLED, _ONCE), np.full(len(heads), _AGAIN)))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(content[number[at]], pa.int64()), pa.array(place[at]), pa.array(kind, pa.int32())], names=["anchor", "content", "place", "kind"])

    return run


_FRAGMENTS = "bucket int, anchor long, windows int, at_word boolean, fragment binary, owners binary"
_SEPARATORS = frozenset(np.flatnonzero(_SPACE).tolist())


def _cut(length: int, gram: int, words: int, buckets: int):
    """The fragments around shared anchors, equal ones of a batch once, with their owners' content, check and start."""

    def run(batches):
        for batch in batches:
            content, check = batch.column("content").to_pylist(), batch.column("check").to_pylist()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            wanted = [set(p) for p in batch.column("places").to_pylist()]
            held: dict[tuple, list] = {}
            for i, start, many, place, anchor in zip(*(x.tolist() for x in anchor_runs(texts, length, gram, words))):
                if place in wanted[i]:
                    at_word = start == 0 or texts[i][start - 1] in _SEPARATORS
                    held.setdefault((anchor, many, at_word, texts[i][start : start + many + length - 1]), []).append((content[i], check[i], start))
            rows: list[list] = [[] for _ in range(6)]
            for (anchor, many, at_word, fragment), owners in held.items():
                for column, x in zip(rows, (anchor % buckets, anchor - (1 << 64) if anchor >> 63 else anchor, many, at_word, fragment, np.array(owners, dtype=np.int64).tobytes())):
                    column.append(x)
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=["bucket", "anchor", "windows", "at_word", "fragment", "owners"])

    return run


def _sort_bucket(length: int, words: int, block: int):
    """content, check, start and end of what is to be removed; a start of -1 says that the text has a passage."""

    def run(table: pa.Table) -> pa.Table:
        held: dict[tuple, set] = {}
        for anchor, many, at_word, fragment, owners in zip(*(table.column(c).to_pylist() for c in ("anchor", "windows", "at_word", "fragment", "owners"))):
            held.setdefault((anchor, many, at_word, fragment), set()).update(map(tuple, np.frombuffer(owners, np.int64).reshape(-1, 3).tolist()))
        keys = sorted(held, key=lambda k: k[0])
        out: list[list] = [[], [], [], []]
        number: dict[tuple, int] = {}
        at = 0
        while at < len(keys):  # whole anchors, about a block at a time
            to, size = at, 0
            while to < len(keys) and (size < block or keys[to][0] == keys[to - 1][0]):
                size += len(keys[to][3])
                to += 1
            part = keys[at:to]
            owners = [np.array(list(held[k]), dtype=np.int64) for k in part]
            single = [(o[:, :2] == o[0, :2]).all() for o in owners]
            owner = np.array([number.setdefault(tuple(o[0, :2].tolist()), len(number)) if one else -1 for o, one in zip(owners, single)])
            masks, passage = repeated_starts([k[3] for k in part], [k[1] for k in part], np.array([len(o) > 1 for o in owners]), owner, np.array([k[2] for k in part]), length, words)
            for mask, has, own in zip(masks, passage, owners):
                if has:
                    for column, x in zip(out, (own[:, 0], own[:, 1], np.full(len(own), -1), np.full(len(own), -1))):
                        column.append(x)
                if mask.any():
                    first, last = _runs(mask)
                    for column, x in zip(out, (np.repeat(own[:, 0], len(first)), np.repeat(own[:, 1], len(first)), (own[:, 2][:, None] + first).ravel(), (own[:, 2][:, None] + last + (length - 1)).ravel())):
                        column.append(x)
            at = to
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        if len(columns[0]):  # a text has a passage once
            mark = columns[2] < 0
            seen = np.unique(np.stack([c[mark] for c in columns], axis=1), axis=0)
            columns = [np.concatenate((c[~mark], seen[:, i])) for i, c in enumerate(columns)]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("content", "check", "start", "end"), columns)})

    return run


_KEPT = "content long, check long, passage boolean, removed long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string"


def _remove(keep_bytes: bool):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            removed, spans, kept, digests = [], [], [], []
            for text, cover in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("cover").to_pylist()):
                own: list[list[int]] = []
                for x in sorted((c["start"], c["end"]) for c in cover):
                    if own and x[0] <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], x[1])
                    else:
                        own.append(list(x))
                edges = [0, *(e for x in own for e in x), len(text)]
                rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                removed.append(len(text) - len(rest))
                spans.append([{"start": a, "end": b} for a, b in own])
                kept.append(rest if keep_bytes and own else None)
                digests.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("content"), batch.column("check"), batch.column("passage"), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(digests)], names=["content", "check", "passage", "removed", "spans", "kept", "kept_sha256"])

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, words: int = WORDS, keep_bytes: bool = False, bucket_bytes: int = BUCKET_BYTES, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row a document: id, n_bytes, removed, spans (start and end of what is removed), kept (bytes,
    where asked for and something is removed), kept_sha256, passage.

    Texts are UTF-8 bytes, null is empty; strings do not cross documents, and both places of a repeat
    are removed, in one document too. A text that occurs in several rows is removed whole if it is
    ``length`` bytes or more; shorter texts are left alone.

    ``passage`` says whether another document has ``words`` whole words of this one as well, in a row
    and with the same bytes between, or any ``length`` bytes; what is shorter is reported, not removed.

    Null and repeated ids are allowed; other columns are ignored. An empty table gives an empty result.
    Very long texts are cut into overlapping segments for the search of anchors only; their windows are
    the same. Texts are told apart by 128 bits of their SHA-256.
    """
    if min(length, 2 * words - 1) < gram:
        raise ValueError("a window must be no shorter than a gram")
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digest = F.sha2("text", 256)
    least, size = min(length, 2 * words - 1), F.octet_length("text")
    # of texts shorter than the length, which are removed by no repeat, whether they hold a passage when repeated whole
    passage_long = (size >= length) | F.when(size >= least, F.size(F.split(F.regexp_replace("text", "^[ \\x09-\\x0D]+|[ \\x09-\\x0D]+$", ""), "[ \\x09-\\x0D]+")) >= words).otherwise(False)
    rows = Saved(source.select("id", size.cast("long").alias("n_bytes"), passage_long.alias("long_enough"), digest.alias("sha")).withColumn("content", F.xxhash64("sha")).withColumn("check", F.xxhash64(F.lit(1), "sha")), "contents")
    copies = rows.df.groupBy("content", "check").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    long = source.where(size >= least).select("id", "text", F.xxhash64(digest).alias("content"), F.xxhash64(F.lit(1), digest).alias("check"))

    anchors = Saved(long.select("content", "text").mapInArrow(_find_anchors(length, gram, words), "anchor long, content long, place long, kind int"), "anchors")
    open_ = anchors.df.where(F.col("kind") != _SETTLED)
    shared = open_.groupBy("anchor").agg(F.max("kind").alias("kind"), F.min("content").alias("a"), F.max("content").alias("b"), F.min("place").alias("c"), F.max("place").alias("d")).where(f"kind = {_AGAIN} or a <> b or c <> d").select("anchor")
    found = open_.where(F.col("kind") == _ONCE).join(shared, "anchor", "left_semi").unionByName(anchors.df.where(F.col("kind") == _SETTLED))
    places = Saved(found.groupBy("content").agg(F.collect_set("place").alias("places")), "places")
    anchors.drop()
    total = places.df.agg(F.sum(F.size("places"))).first()[0] or 0
    buckets = parts(total * (length + (length - gram) // 2), bucket_bytes)
    asked = places.df.join(copies, "content").select(F.col("content").alias("c"), F.col("check").alias("k"), "rep", "places")
    texts = Saved(long.join(asked, (F.col("content") == F.col("c")) & (F.col("check") == F.col("k")) & F.col("id").eqNullSafe(F.col("rep"))).select("content", "check", "text", "places"), "texts")
    fragments = texts.df.mapInArrow(_cut(length, gram, words, buckets), _FRAGMENTS)
    spans = fragments.groupBy("bucket").applyInArrow(_sort_bucket(length, words, block_bytes), "content long, check long, start long, end long")
    span = F.when(F.col("start") >= 0, F.struct("start", "end"))
    cover = spans.groupBy("content", "check").agg(F.collect_list(span).alias("cover"), F.max(F.col("start") < 0).alias("passage"))
    changed = Saved(texts.df.select("content", "check", "text").dropDuplicates(["content", "check"]).join(cover, ["content", "check"]).mapInArrow(_remove(keep_bytes), _KEPT), "kept")
    for done in (places, texts):
        done.drop()

    several = copies.where("copies > 1").select("content", "check", "copies")
    facts = several.join(changed.df, ["content", "check"], "full")
    out = join_unique(rows.df, facts, ["content", "check"], "copies", weights=several)
    again = F.coalesce(F.col("copies") > 1, F.lit(False))
    whole = again & (F.col("n_bytes") >= length)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select(
        "id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("removed"),
        F.when(whole, all_of_it).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(whole, F.lit(b"") if keep_bytes else F.lit(None).cast("binary")).otherwise(F.col("kept")).alias("kept"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        (F.coalesce("passage", F.lit(False)) | (again & F.col("long_enough"))).alias("passage"),
    )


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document, and whether it has a passage of
    over 50 words that another document has as well (repeats_passage), which may be too short to be removed."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", F.col("removed").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", F.col("passage").alias("repeats_passage"))
