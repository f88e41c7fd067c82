"""Literal dictionaries matched in texts: by an automaton below a checked size, by joins beyond it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from veilframe.operators.detect import expand_matches, sweep

GRAM = 6  # code points of a literal that a text position is tested on first
AUTOMATON_LITERALS, AUTOMATON_BYTES = 20_000, 1 << 20  # dictionaries up to this size become one automaton a task
BROADCAST_LITERALS = 200_000  # dictionaries up to this many rows and ...
BROADCAST_BYTES = 32 << 20  # ... this many bytes of text are broadcast
# Greatest sizes of the position test for larger dictionaries; sixteen bits a literal below them.
BITS = 1 << 30  # bits of hashed beginnings, and as many of hashed whole literals
BUCKETS = 1 << 22  # hash buckets of beginnings, each with a mask of lengths
SCANNED = 1 << 19  # bytes of text that are tested at a time


def automaton_candidates(docs: DataFrame, values: list[str], by: list[str], keep: list[str], whole: bool) -> DataFrame:
    """All places of the given strings in the texts, overlapping ones too: one pass over Arrow batches.

    The strings are a dictionary of checked size; each task builds one automaton of them.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(values)
    carried = docs.select("doc_id", *by, *keep, "text")
    names = carried.columns[:-1]

    def scan(batches):
        import ahocorasick

        words = shared.value
        trie = ahocorasick.Automaton()
        for k, word in enumerate(words):
            trie.add_word(word, k)
        trie.make_automaton()
        for batch in batches:
            rows, starts, which = [], [], []
            for i, text in enumerate(batch.column(len(names)).to_pylist()):
                for last, k in trie.iter(text) if text else ():
                    n = len(words[k])
                    start = last + 1 - n
                    if whole and ((start and "0" <= text[start] <= "9" and "0" <= text[start - 1] <= "9") or (
                            last + 1 < len(text) and "0" <= text[last] <= "9" and "0" <= text[last + 1] <= "9")):
                        continue
                    rows.append(i)
                    starts.append(start)
                    which.append(words[k])
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(j).take(at) for j in range(len(names))), pa.array(starts, pa.int32()), pa.array(which, pa.string())],
                [*names, "start", "literal"])

    schema = T.StructType([*carried.schema.fields[:-1], T.StructField("start", T.IntegerType()), T.StructField("literal", T.StringType())])
    return carried.filter("text is not null").mapInArrow(scan, schema)


def _codes(texts: list[str]):
    """Code points of texts, one after the other, and where each text begins; the last number is the end."""
    import numpy as np

    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    begins = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) >> 2 for r in raw], out=begins[1:])
    return np.frombuffer(b"".join(raw), np.uint32).astype(np.uint64), begins


def _mixed(h):
    """Well spread 64 bits of polynomial hashes, whose low bits alone depend on few code points."""
    import numpy as np

    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _prefixes(codes):
    """Hash of every prefix of the code points, and the powers that take a prefix away; the prime part is modulo 2**64."""
    import numpy as np

    prime = np.uint64(0x100000001B3)
    powers = np.ones(len(codes) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(codes), prime), out=powers[1:])
    # sum of code * prime**position; a piece is compared after it is moved to one position by the inverse power
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * powers[:-1], out=sums[1:])
    inverse = np.ones(len(codes) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(codes), np.uint64(pow(0x100000001B3, -1, 1 << 64))), out=inverse[1:])
    return sums, inverse


def _hashes(sums, inverse, starts, n):
    """Hash of the pieces of ``n`` code points at ``starts``."""
    return (sums[starts + n] - sums[starts]) * inverse[starts]


def literal_places(lits: DataFrame, by: list[str], count: int) -> tuple:
    """What positions are tested on: arrays that grow with the number of literals up to a fixed greatest size.

    A bit for each hash of a beginning, the lengths of the literals of each hash bucket of beginnings as a mask (the last
    bit for all greater ones), two bits for each hash of a whole literal, and the lengths that beginnings of each size have.
    """
    import numpy as np
    import pyarrow as pa

    bits = min(max(1 << 20, 1 << (16 * count).bit_length()), BITS)
    buckets = min(max(1 << 16, bits >> 6), BUCKETS)
    one, low = np.uint64(1), np.uint64(63)

    def hashed(batches):
        for batch in batches:
            words, seeds = batch.column(1).to_pylist(), batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            codes, begins = _codes(words)
            sums, inverse = _prefixes(codes)
            n = np.diff(begins)
            k = np.minimum(n, GRAM)
            first = _mixed(_hashes(sums, inverse, begins[:-1], k) + seeds + k.astype(np.uint64))
            whole = _mixed(_hashes(sums, inverse, begins[:-1], n) + seeds)
            at = [x & np.uint64(bits - 1) for x in (first, whole, whole >> np.uint64(32))]
            masks = [*(one << (x & low) for x in at), one << np.minimum(n, 63).astype(np.uint64), one << k.astype(np.uint64)]
            places = [*(x >> np.uint64(6) for x in at), (first >> np.uint64(40)) & np.uint64(buckets - 1), n]
            kinds = [0, 1, 1, 2, 3]  # beginnings, whole literals, lengths by bucket, sizes of beginnings by length
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(kinds, len(words))), pa.array(np.concatenate([x.astype(np.int64) for x in places])),
                pa.array(np.concatenate(masks).view(np.int64))], ["kind", "place", "mask"])

    rows = lits.select(_seed(by), "literal").mapInArrow(hashed, "kind long, place long, mask long")
    kind, place, mask = (c.to_numpy() for c in rows.groupBy("kind", "place").agg(F.bit_or("mask").alias("mask")).toArrow().columns)
    tables = []
    for which, size in enumerate((bits >> 6, bits >> 6, buckets)):
        tables.append(np.zeros(size, np.uint64))
        tables[-1][place[kind == which]] = mask[kind == which].view(np.uint64)
    sizes = {}
    for n, held in sorted(zip(place[kind == 3].tolist(), mask[kind == 3].tolist())):
        sizes.setdefault(min(n, GRAM), []).append(n)
    return *tables, sizes


def _found(places: tuple, texts: list[str], seeds, whole: bool, spans=None) -> tuple:
    """Number of the text, start and length of the places of some texts where a literal may stand, as arrays.

    ``spans`` are starts, ends and their number in each text, in order: what lies in the last one that begins before it is left out.
    """
    import numpy as np

    firsts, wholes, lengths, sizes = places
    mask, bucket = np.uint64((len(wholes) << 6) - 1), np.uint64(len(lengths) - 1)
    six, low, one = np.uint64(6), np.uint64(63), np.uint64(1)

    def held(table, at):
        return (table[(at >> six).astype(np.int64)] >> (at & low)) & one == one

    codes, begins = _codes(texts)
    sums, inverse = _prefixes(codes)
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(begins))
    seed = seeds[rows]
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k, some in sizes.items():
        m = len(codes) - k + 1
        if m <= 0:
            continue
        h = _mixed((sums[k:] - sums[:m]) * inverse[:m] + seed[:m] + np.uint64(k))
        starts = np.flatnonzero(held(firsts, h & mask))
        mine = lengths[((h[starts] >> np.uint64(40)) & bucket).astype(np.int64)]
        for n in some:
            at = starts[(mine >> np.uint64(min(n, 63))) & one == one]
            at = at[at + n <= begins[rows[at] + 1]]
            h = _mixed(_hashes(sums, inverse, at, n) + seed[at])
            near = held(wholes, h & mask)
            at = at[near][held(wholes, (h[near] >> np.uint64(32)) & mask)]
            out.append((at, np.full(len(at), n)))
    at, n = (np.concatenate(x) for x in zip(*out))
    row = rows[at]
    keep = np.ones(len(at), bool)
    if whole:
        digit = np.concatenate([(codes >= 48) & (codes <= 57), [False]])
        keep &= ~(digit[at] & digit[at - 1] & (at > begins[row])) & ~(digit[at + n - 1] & digit[at + n] & (at + n < begins[row + 1]))
    if spans is not None:
        starts, ends, many = spans
        first = np.repeat(begins[:-1], many)
        last = np.searchsorted(starts + first, at, "right") - 1
        keep &= (last < 0) | (np.concatenate([ends + first, [0]])[last] < at + n)
    at, n, row = at[keep], n[keep], row[keep]
    return row, at - begins[row], n


def _some(sizes, most: int):
    """Ranges of texts that are tested at a time, so that the arrays stay small."""
    import numpy as np

    sums, done = np.cumsum(sizes.astype(np.int64)), 0
    while done < len(sums):
        stop = max(done + 1, int(np.searchsorted(sums, (sums[done - 1] if done else 0) + most, "right")))
        yield done, stop
        done = stop


def _seed(by: list[str]) -> Column:
    """Literals of one group (tenant, session) have hashes of their own."""
    return F.xxhash64(*[F.col(c).cast("string") for c in by]).alias("__seed") if by else F.lit(0).cast("bigint").alias("__seed")


def position_candidates(docs: DataFrame, lits: DataFrame, by: list[str], keep: list[str], whole: bool, count: int) -> DataFrame:
    """Places where a literal of a dictionary of any size may stand.

    The six code points after every text position (fewer for shorter literals) are looked up among the hashed beginnings;
    where there is one, its hash bucket gives the lengths of the literals which may start so, and the piece of each length is
    a candidate if the hash of a whole literal has its bits. What is broadcast has a fixed greatest size. Candidates are no
    hits yet: they meet the dictionary by equality.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    shared = docs.sparkSession.sparkContext.broadcast(literal_places(lits, by, count))
    carried = docs.select("doc_id", *by, *keep, _seed(by), "text")
    names = carried.columns[:-2]

    def scan(batches):
        import numpy as np

        for batch in batches:
            texts, seeds = batch.column(len(names) + 1), batch.column(len(names)).to_numpy(zero_copy_only=False).view(np.uint64)
            for done, stop in _some(pc.binary_length(texts).to_numpy(zero_copy_only=False), SCANNED):
                some = texts.slice(done, stop - done).to_pylist()
                row, start, n = _found(shared.value, some, seeds[done:stop], whole)
                found = [some[i][a:a + m] for i, a, m in zip(row.tolist(), start.tolist(), n.tolist())]
                at = pa.array(row + done, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(j).take(at) for j in range(len(names))), pa.array(start, pa.int32()), pa.array(found, pa.string())],
                    [*names, "start", "literal"])

    schema = T.StructType([*carried.schema.fields[:-2], T.StructField("start", T.IntegerType()), T.StructField("literal", T.StringType())])
    return carried.filter("text is not null").mapInArrow(scan, schema)


def standing_free(texts: DataFrame, literals: DataFrame, by: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """Those of the literals (``by``, literal) that stand somewhere in the texts outside the spans.

    ``texts`` has text, the ``by`` columns and arrays ``starts`` and ``ends`` of spans in order which do not overlap: a place
    counts as inside when the last span that begins before it covers it. Each task names a literal once.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    by = list(by)
    lits = literals.select(*by, "literal").filter(F.length("literal") > 0).distinct()
    shared = texts.sparkSession.sparkContext.broadcast(literal_places(lits, by, lits.count()))
    carried = texts.select(*by, _seed(by), "starts", "ends", "text")

    def scan(batches):
        import numpy as np

        seen = set()
        for batch in batches:
            groups, (seeds, starts, ends, text) = batch.columns[:len(by)], batch.columns[len(by):]
            seeds = seeds.to_numpy(zero_copy_only=False).view(np.uint64)
            for done, stop in _some(pc.binary_length(text).to_numpy(zero_copy_only=False), SCANNED):
                some, cut = text.slice(done, stop - done).to_pylist(), slice(done, stop)
                spans = [x[cut].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (starts, ends)]
                many = pc.list_value_length(starts[cut]).to_numpy(zero_copy_only=False)
                row, start, n = _found(shared.value, some, seeds[done:stop], whole, (*spans, many))
                keys = [g[cut].to_pylist() for g in groups]
                new = {(*(k[i] for k in keys), some[i][a:a + m]) for i, a, m in zip(row.tolist(), start.tolist(), n.tolist())} - seen
                seen |= new
                columns = zip(*new) if new else [[]] * (len(by) + 1)
                kinds = [*(g.type for g in groups), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], [*by, "literal"])

    schema = T.StructType([*carried.schema.fields[:len(by)], T.StructField("literal", T.StringType())])
    found = carried.filter("text is not null").mapInArrow(scan, schema).distinct()
    return lits.join(found, [*by, "literal"], "left_semi")


def all_places(docs: DataFrame, literals: DataFrame, by: tuple[str, ...] = (), keep: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """Every place of every literal, overlapping ones included: (doc_id, by, keep, value, start, end, payload).

    ``literals`` has ``literal``, the ``by`` columns and a payload. Small dictionaries are searched by an automaton in
    one pass over the texts, larger ones by joins. ``whole`` leaves out hits that begin or end inside a run of digits.
    """
    by, keep = list(by), list(keep)
    payload = [c for c in literals.columns if c not in by and c != "literal"]
    lits = literals.filter(F.length("literal") > 0)
    stats = lits.agg(F.count(F.lit(1)), F.sum(F.octet_length("literal"))).first()
    count, size = stats[0], stats[1] or 0
    small = count <= BROADCAST_LITERALS and size <= BROADCAST_BYTES
    if count <= AUTOMATON_LITERALS and size <= AUTOMATON_BYTES:
        candidates = automaton_candidates(docs, sorted({r[0] for r in lits.select("literal").collect()}), by, keep, whole)
    else:
        candidates = position_candidates(docs, lits, by, keep, whole, count)
    found = candidates.join(F.broadcast(lits) if small else lits, [*by, "literal"])
    return found.select("doc_id", *by, *keep, F.col("literal").alias("value"), "start",
                        (F.col("start") + F.length("literal")).cast("int").alias("end"), *payload)


def match_literals(docs: DataFrame, literals: DataFrame, by: tuple[str, ...] = (), keep: tuple[str, ...] = (),
                   condition: Column | None = None, whole: bool = False) -> DataFrame:
    """Leftmost-longest, non-overlapping hits of a literal dictionary, wherever a literal stands in a text.

    ``docs`` has doc_id, text, the ``by`` and the ``keep`` columns; see ``all_places`` for the rest.
    """
    found = all_places(docs, literals, by, keep, whole)
    if condition is not None:
        found = found.filter(condition)
    return sweep(found.repartition("doc_id"), [-F.col("end")])


def alternation(values: list[str]) -> str:
    """Literals as one pattern, longest first."""
    return "|".join("\\Q" + v.replace("\\E", "\\E\\\\E\\Q") + "\\E" for v in sorted(set(values), key=lambda v: (-len(v), v)))


def match_list(docs: DataFrame, values: list[str]) -> DataFrame:
    """Hits of a short driver-side list (deny list); longer lists go through ``match_literals``."""
    pattern = alternation(values)
    scanned = docs.filter(F.col("text").rlike(pattern)).select("tenant", "doc_id", "text", F.lit(0).alias("prio"))
    return expand_matches(scanned, [pattern], [0]).select("tenant", "doc_id", "value", "start", "end")


def detect_denylist(docs: DataFrame, values: list[str] | DataFrame) -> DataFrame:
    """Values that are always replaced: literal, longest first, confidence 1, category custom."""
    if isinstance(values, DataFrame):
        hits = match_literals(docs, values.select(F.col("value").alias("literal")).distinct(), keep=("tenant",))
    elif len(values) > 64:
        spark = docs.sparkSession
        hits = match_literals(docs, spark.createDataFrame([(v,) for v in sorted(set(values))], "literal string"), keep=("tenant",))
    else:
        hits = match_list(docs, values)
    return hits.select("tenant", "doc_id", "value", "start", "end", F.lit("custom").alias("category"),
                       F.lit(1.0).alias("confidence"), F.lit("denylist").alias("detector"))
