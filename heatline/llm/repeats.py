"""Long repeated byte strings of a corpus, found with run-length Burrows-Wheeler indexes.

A string of ``length`` bytes is repeated if it starts at two places of the corpus.
Each text is cut into overlapping phrases: the neighbouring windows of ``length``
bytes whose least 32-byte hash (the minimizer) is the same. Equal windows have equal
minimizers, so windows need comparing only within the phrases of one minimizer, and
a phrase is done with whose minimizer is in no other and not twice in itself. Equal phrases are counted, and one
of each, with its bytes, is sent to its minimizer's task.

There the phrases are indexed together: suffix order, the runs of equal letters
before neighbouring suffixes (the run-length transform), and, kept only at both ends
of each run, the length of the match with the neighbour across the border. Inside a
run the letters before agree, so a match one byte earlier is one longer: streaming
over a phrase, a place's matching statistic is that of the last run end less the
bytes since. Where it is at least ``length``, a repeated window starts.

Work grows with the texts: a window belongs to one phrase, a phrase to one
minimizer. Copies of a text are one text, copies of a phrase (equal minimizer and equal
XXH3 of its bytes) one phrase with a count. A minimizer in very many different phrases (a common line) is found on a
sample and its phrases are cut to single windows, dealt out by their own hashes;
this only decides where windows meet, never which are compared.

Defined results: NULL is empty; texts shorter than ``length`` keep everything;
repeated rows repeat all their windows, and get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from heatline.llm.batches import SpanHash, arrow_schema, flat, fresh, steps

#: Windows of a phrase at most; longer runs of one minimizer are several phrases.
PHRASE_WINDOWS = 1023
#: Bytes of phrases that are indexed together, unless one minimizer has more.
INDEX_BYTES = 1 << 18
#: One text in so many is looked at for crowded minimizers.
SAMPLE = 64
#: Different phrases of a minimizer in the sample from which it is crowded.
CROWDED = 160
#: Crowded minimizers that are told the tasks; the rest are merely slower.
MOST_CROWDED = 100_000
_KEY = ["ha", "hb"]
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def _sliding(pick: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """``pick`` (least or greatest) of every ``width`` neighbouring values."""
    size = 1
    while 2 * size <= width:
        values = pick(values[: len(values) - size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def minimizers(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``length`` bytes the least hash of its k-byte strings.

    Also, for every such string, if its hash is that of a window and the same as at the
    next string like that: only around those can a phrase repeat a window of its own.
    """
    k = 1 << max(0, (length // 4).bit_length() - 1)
    base = 0x9E3779B97F4A7C15
    hashes = (data.astype(np.uint64) + np.uint64(1)) * _SPREAD
    hashes ^= hashes >> np.uint64(32)
    size = 1
    while size < k:
        hashes = hashes[: len(hashes) - size] * np.uint64(pow(base, size, 1 << 64)) + hashes[size:]
        size *= 2
    hashes ^= hashes >> np.uint64(32)
    hashes *= _SPREAD
    hashes ^= hashes >> np.uint64(29)
    width = length - k + 1
    least = _sliding(np.minimum, hashes, width)
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.maximum, np.concatenate((edge, least, edge)), width) == hashes)
    twin = np.zeros(len(hashes), bool)
    twin[at[:-1][hashes[at[1:]] == hashes[at[:-1]]]] = True
    return least, twin


_HASH = SpanHash(3)


def phrases(data: np.ndarray, offsets: np.ndarray, length: int, crowded: np.ndarray):
    """Row, first byte, windows, minimizer and content hash of every phrase of some texts.

    Last, whether the phrase may hold a window twice.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    least, twin = minimizers(data, length)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[: len(least)] == row[length - 1 :]
    border = np.ones(len(least) + 1, bool)
    border[1:-1] = (
        (least[1:] != least[:-1])
        | (inside[1:] != inside[:-1])
        | (row[1 : len(least)] != row[: len(least) - 1])
    )
    at = np.flatnonzero(border)
    first, count = at[:-1], np.diff(at)
    keep = inside[first]
    first, count = first[keep], count[keep]
    if len(crowded):
        place = np.minimum(np.searchsorted(crowded, least[first]), len(crowded) - 1)
        most = np.where(crowded[place] == least[first], 1, PHRASE_WINDOWS)
    else:
        most = np.full(len(first), PHRASE_WINDOWS)
    many = -(-count // most)
    part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    most = np.repeat(most, many)
    count = np.minimum(np.repeat(count, many) - part * most, most)
    first = np.repeat(first, many) + part * most
    last = first + count + length - 1
    raw = data.tobytes()
    digests = (xxh3_64_intdigest(raw[a:b], 3) for a, b in zip(first.tolist(), last.tolist()))
    content = np.fromiter(digests, np.uint64, len(first))
    # Single windows are dealt out by another hash of theirs, so two agree in every case.
    key = least[first]
    single = most == 1
    key[single] = _HASH(data, first[single], last[single])
    twins = np.append(0, np.cumsum(twin))
    end = first + count + len(twin) - len(least)
    inner = (count > 1) & (twins[end] > twins[first])
    return row[first], first - offsets[row[first]], count, key, content, inner


def _with_keys(docs: DataFrame, text: str, names: dict[str, str] | None = None) -> DataFrame:
    """Two 64-bit hashes that name a text."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    names = names or dict(zip(_KEY, _KEY))
    return docs.withColumns({names["ha"]: F.xxhash64(body), names["hb"]: F.xxhash64(F.lit(11), body)})


def _phrase_rows(texts: DataFrame, length: int, crowded) -> DataFrame:
    """(mh, sh, ha, hb, place, inner) of all phrases; a place is first byte * 1024 + windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = crowded.value if crowded else np.zeros(0, np.uint64)
        for batch in batches:
            data, offsets = flat(batch.column(2))
            for a, b in steps(offsets):
                part = offsets[a : b + 1]
                row, first, count, key, content, inner = phrases(
                    data[part[0] : part[-1]], part - part[0], length, known
                )
                named = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)),
                        pa.array(content.view(np.int64)),
                        batch.column(0).take(named),
                        batch.column(1).take(named),
                        pa.array(first << 10 | count),
                        pa.array(inner),
                    ],
                    ["mh", "sh", "ha", "hb", "place", "inner"],
                )

    schema = "mh long, sh long, ha long, hb long, place long, inner boolean"
    return texts.select(*_KEY, "text").mapInArrow(run, schema)


def _crowded(docs: DataFrame, length: int):
    """Broadcast sorted minimizers of many different phrases, by a sample of the texts."""
    sample = docs.filter(F.col("ha") % SAMPLE == 0)
    found = (
        _phrase_rows(sample, length, None)
        .groupBy("mh")
        .agg(F.count_distinct("sh").alias("n"))
        .filter(F.col("n") >= CROWDED)
        .orderBy(F.desc("n"), "mh")
        .limit(MOST_CROWDED)
        .select("mh")
        .toPandas()["mh"]
    )
    keys = np.sort(found.to_numpy(np.int64).view(np.uint64))
    return docs.sparkSession.sparkContext.broadcast(keys) if len(keys) else None


def suffix_order(words: np.ndarray, size: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """All suffixes in order, given their first seven letters, lengths and phrases.

    Suffixes that are equal to their ends are in the order of their phrases.
    """
    n = len(words)
    order = np.argsort(words)
    ranked = words[order]
    head = np.append(True, ranked[1:] != ranked[:-1])
    rank = np.empty(n, np.int64)
    start = np.flatnonzero(head)
    rank[order] = np.repeat(start, np.diff(np.append(start, n)))
    known = 7
    while True:
        tied = ~head | np.append(~head[1:], False)
        slots = np.flatnonzero(tied)
        if not len(slots):
            return order
        at = order[slots]
        # What lies behind a phrase's end sorts first.
        follow = np.where(size[at] > known, rank[np.minimum(at + known, n - 1)] + n, phrase[at])
        both = rank[at] * (2 * n) + follow
        by = np.argsort(both, kind="stable")
        at, both = at[by], both[by]
        order[slots] = at
        new = np.append(True, both[1:] != both[:-1])
        head[slots] = new
        # Each group keeps the first of its slots as rank.
        begin = np.flatnonzero(new)
        rank[at] = np.repeat(slots[begin], np.diff(np.append(begin, len(at))))
        known *= 2


def _common(words: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many letters the suffixes at ``a`` and ``b`` share."""
    out = np.zeros(len(a), np.int64)
    most = np.minimum(size[a], size[b])
    active = np.arange(len(a))
    while len(active):
        at = out[active]
        differ = words[a[active] + at] ^ words[b[active] + at]
        same = np.zeros(len(active), np.int64)
        for k in range(7):
            same += (differ >> (54 - 9 * k)) == 0
        out[active] = np.minimum(at + same, most[active])
        active = active[(same == 7) & (out[active] < most[active])]
    return out


def matching_statistics(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each byte of some phrases (ending at ``ends``) its longest match elsewhere in them."""
    n = len(data)
    starts = np.append(0, ends[:-1])
    phrase = np.repeat(np.arange(len(ends)), ends - starts)
    size = ends[phrase] - np.arange(n)
    # Seven letters of nine bits; behind a phrase's end the letters are 0.
    letters = np.append(data.astype(np.int64) + 1, np.zeros(7, np.int64))
    words = np.zeros(n, np.int64)
    for k in range(7):
        words = words << 9 | np.where(size > k, letters[k : n + k], 0)
    order = suffix_order(words, size, phrase)
    before = np.append(0, data[:-1].astype(np.int64) + 1)
    before[starts] = 0
    transform = before[order]
    # Run heads; whatever starts a phrase is a run of its own.
    head = np.flatnonzero((transform[1:] != transform[:-1]) | (transform[1:] == 0)) + 1
    shared = _common(words, size, order[head - 1], order[head])
    place = np.arange(n)
    out = np.zeros(n, np.int64)
    for where in (order[head], order[head - 1]):
        sampled = np.full(n, -1)
        sampled[where] = shared
        # The least and the greatest suffix have no neighbour on one side.
        sampled[starts] = np.maximum(sampled[starts], 0)
        last = np.maximum.accumulate(np.where(sampled >= 0, place, 0))
        out = np.maximum(out, sampled[last] - (place - last))
    return out


def repeated_windows(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Mask of the bytes at which a string of ``length`` bytes starts that starts elsewhere too."""
    return matching_statistics(data, ends) >= length


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each stretch of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2] - edge[::2]


def _marks(slices: DataFrame, length: int) -> DataFrame:
    """(mh, sh, runs) of phrases with repeated windows; a run is first window * 1024 + count."""

    def indexed(rows: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        ends = np.cumsum([len(r[3]) for r in rows])
        mask = repeated_windows(data, ends, length)
        mh, sh, found = [], [], []
        for (minimizer, content, copies, body), end in zip(rows, ends.tolist()):
            windows = len(body) - length + 1
            if copies > 1:
                runs = [windows]
            else:
                at, n = _runs(mask[end - len(body) : end - length + 1])
                runs = (at << 10 | n).tolist()
            if runs:
                mh.append(minimizer)
                sh.append(content)
                found.append(runs)
        return pa.RecordBatch.from_arrays(
            [pa.array(mh, pa.int64()), pa.array(sh, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
            ["mh", "sh", "runs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if size >= INDEX_BYTES and row[0] != held[-1][0]:
                    yield indexed(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield indexed(held)

    by_minimizer = slices.repartition("mh").sortWithinPartitions("mh")
    return by_minimizer.mapInArrow(run, "mh long, sh long, runs array<long>")


def _slices(asked: DataFrame, length: int) -> DataFrame:
    """(mh, sh, copies, body) of the asked phrases of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(0))
            wanted = batch.column(1)
            for k in range(batch.num_rows):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                fields = [wanted[k].values.field(j) for j in range(4)]
                place = fields[3].to_numpy(zero_copy_only=False)
                first, count = place >> 10, place & 1023
                body = [text[a : a + n + length - 1] for a, n in zip(first.tolist(), count.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*fields[:3], pa.array(body, pa.binary())], ["mh", "sh", "copies", "body"]
                )

    return asked.select("text", "asked").mapInArrow(run, "mh long, sh long, copies long, body binary")


def marked_texts(docs: DataFrame, length: int, text: str = "text") -> DataFrame:
    """(ha, hb, text, same, marks) of every distinct text with runs of repeated windows.

    ``same`` counts the rows of the text; with more than one all its windows are repeated.
    One plan, whose exchanges of texts and of shared phrases are each made once and reused:
    every branch asks for the same columns and filters, or Spark would make another.
    """
    keyed = _with_keys(
        docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")), "text"
    ).select(*_KEY, F.encode("text", "utf-8").alias("text"))
    crowded = _crowded(keyed, length)
    texts = keyed.groupBy(*_KEY).agg(F.first("text").alias("text"), F.count("*").alias("same"))
    texts = texts.filter("same > 0 AND ha IS NOT NULL AND hb IS NOT NULL")
    rows = _phrase_rows(texts, length, crowded)
    counted = rows.groupBy("mh").agg(F.count("*").alias("n"), F.max("inner").alias("inner"))
    shared = counted.filter("n > 1 OR inner").select("mh")
    named = rows.filter(" AND ".join(f"{c} IS NOT NULL" for c in ("mh", "sh", *_KEY)))
    shared_rows = named.join(shared, "mh")
    one = (
        shared_rows.groupBy("mh", "sh")
        .agg(F.count("*").alias("copies"), F.min(F.struct("ha", "hb", "place")).alias("one"))
        .select("mh", "sh", "copies", "one.*")
    )
    asked = one.groupBy(*_KEY).agg(
        F.collect_list(F.struct("mh", "sh", "copies", "place")).alias("asked")
    )
    marks = _marks(_slices(texts.join(asked, _KEY), length), length)
    spread = (
        shared_rows.join(marks, ["mh", "sh"])
        .select(*_KEY, F.shiftright("place", 10).alias("first"), F.explode("runs").alias("run"))
        .select(
            *_KEY,
            (F.col("first") + F.shiftright("run", 10)).alias("at"),
            F.col("run").bitwiseAND(F.lit(1023)).alias("n"),
        )
    )
    by_text = spread.groupBy(*_KEY).agg(F.collect_list(F.struct("at", "n")).alias("marks"))
    return texts.join(by_text, _KEY, "left")


def _kept(marked: DataFrame, length: int, with_text: bool) -> DataFrame:
    """(ha, hb, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of marked texts.

    ``kept`` leaves out the rest of a parted character as well.
    """
    schema = arrow_schema(
        [(k, T.LongType()) for k in (*_KEY, "n_bytes", "n_removed", "n_spans")]
        + [("kept_sha256", T.StringType())]
        + [("kept", T.StringType())] * with_text
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(2))
            marks, same = batch.column(3), batch.column(4).to_numpy()
            sizes, removed, spans, digests, kept = [], [], [], [], []
            for k in range(batch.num_rows):
                body = data[offsets[k] : offsets[k + 1]]
                n = 0
                if same[k] > 1 and len(body) >= length:
                    n, body = 1, body[:0]
                elif marks[k].is_valid:
                    fields = marks[k].values
                    at = fields.field("at").to_numpy(zero_copy_only=False)
                    count = fields.field("n").to_numpy(zero_copy_only=False)
                    change = np.zeros(len(body) + 1, np.int64)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + count + length - 1, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    n = len(_runs(gone)[0])
                    body = body[~gone]
                raw = body.tobytes()
                sizes.append(int(offsets[k + 1] - offsets[k]))
                removed.append(sizes[-1] - len(raw))
                spans.append(n)
                digests.append(hashlib.sha256(raw).hexdigest())
                if with_text:
                    kept.append(raw.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)),
                    pa.array(digests, pa.string()),
                    *([pa.array(kept, pa.string())] if with_text else []),
                ],
                schema.names,
            )

    return marked.select(*_KEY, "text", "marks", "same").mapInArrow(run, schema)


def removals(docs: DataFrame, length: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    kept = _kept(marked_texts(docs, length, text), length, with_text=False)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _with_keys(rows, "text").select("doc_id", *_KEY).join(kept, _KEY).drop(*_KEY)


def without_repeats(docs: DataFrame, length: int, text: str = "text") -> DataFrame:
    """``docs`` with every covered byte of ``text`` removed, all rows and columns kept.

    Where a cut parts a character its remaining bytes go as well. NULL stays NULL.
    """
    marked = marked_texts(docs, length, text).filter(
        f"marks IS NOT NULL OR same > 1 AND octet_length(text) >= {int(length)}"
    )
    kept = _kept(marked, length, with_text=True)
    names = {k: fresh(docs, k) for k in _KEY}
    shorter = fresh(docs, "kept_text")

    kept = kept.select(*_KEY, "kept")
    kept = kept.withColumnsRenamed({**names, "kept": shorter})
    joined = _with_keys(docs, text, names).join(kept, list(names.values()), "left")
    columns = [
        F.coalesce(F.col(shorter), F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`")
        for c in docs.columns
    ]
    return joined.select(*columns)
