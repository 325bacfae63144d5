"""Secret scans with DataFrame functions only.

Three kinds of base matches are found by patterns: ``assign`` (a key's name, a separator and a value of
eight characters or more), ``access`` (AKIA and capitals or digits, 16 characters or more) and ``hex`` (32
lower-case hex digits or more). To these the entropy scan adds spans: runs of WINDOW characters or more of
one alphabet are slid over by a window, whose Shannon entropy is kept up by the counts of the character that
enters and the one that leaves; the run counts from the first to the last window that reaches its
alphabet's bound. Runs on the allow-list (plain words, numbers, samples) and spans inside a base match are
left out.

A run may join words and values, so the ``piece`` kind judges its windows by their own characters too: every
stretch of a run that is of one of the alphabets of PIECES, within one piece between separators, is slid over
under that alphabet's bound. Pieces without both a letter and a digit, or with the word of a sample, and spans
inside a base match or an entropy span are left out. Where a run is on the allow-list because some of its pieces
hold the word of a sample, its other pieces are judged like those of any run, and the stretches between such
pieces like whole runs.

Places are code points, ends exclusive. Null text counts as empty. Repeated rows are rows of their own. Very long
texts, runs and lists of matches are taken whole: the patterns use possessive groups, which the regex engine
repeats without recursion, sums and largest ends up to each match are taken in blocks of about the square root of
their number, and a window looks at no more than its own characters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs of these cannot begin within a longer one, so the least length may stand in the pattern itself.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy", "piece")
WINDOW = 20
#: Characters of runs have codes from that of + to that of z; their counts fill ten words of eight bytes.
FIRST_CODE, COUNT_WORDS = 43, 10
LONG_RUN = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Least entropy, in bits a character, of a window over hex digits and over the larger alphabet.
HEX_BITS, TEXT_BITS = 3.0, 3.9
#: Alphabets of stretches within a piece of a run, and the least entropy of a window over each.
PIECES = (("0-9a-f", 3.0), ("0-9A-F", 3.0), ("0-9a-z", 3.4), ("0-9A-Z", 3.4), ("0-9A-Za-z", 3.7))
SAMPLES = "example|sample|dummy|placeholder|changeme|xxxxx|0123456789|abcdefgh"
#: What is left of a run between the pieces that hold the word of a sample.
UNSAMPLED = rf"(?:[+/_=-]|(?<![0-9A-Za-z])(?![0-9A-Za-z]*(?i:{SAMPLES}))[0-9A-Za-z]++)++"
#: Runs that are no secrets: plain or joined words, numbers and dates, and samples.
ALLOWED = r"^(?:[A-Za-z]++(?:[+/_=-]++[A-Za-z]++)*+|[0-9+/_=-]+|(?i:.*(?:example|sample|dummy|placeholder|changeme|xxxxx|0123456789|abcdefgh).*)|[^0-9]*|[^A-Za-z]*)[+/_=-]*$"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once, also where body has it inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def _blocks(array: Column, size: Column) -> Column:
    """The array's elements in arrays of a size."""
    return F.when(F.size(array) > 0, F.transform(F.sequence(F.lit(0), F.size(array) - 1, size), lambda i: F.slice(array, i + 1, size))).otherwise(F.array())


def _of(value: Column, function: str) -> Column:
    """A function written in SQL applied to value, which is computed once.

    What is deeply nested or used in many places is written so: text is parsed at once, while the same built of columns
    takes some thousands of calls from Python to the JVM, which cost more than all else for a query over few rows.
    """
    return F.get(F.call_function("transform", F.array(value), F.expr(function)), 0)


def _sum(a: str, b: str) -> str:
    return f"{a} + {b}"


def _greatest(a: str, b: str) -> str:
    return f"greatest({a}, {b})"


def _scan(array: str, merge) -> str:
    """SQL of an array of ints of 0 and more -> for each element merge over those before it, 0 for none (merge: _sum or _greatest)."""
    few = lambda x: f"aggregate({x}, named_struct('now', 0, 'out', cast(array() AS array<int>)), (acc, v) -> named_struct('now', {merge('acc.now', 'v')}, 'out', concat(acc.out, array(acc.now))))"
    block = "cast(ceil(sqrt(size(xs))) AS int)"
    blocks = f"transform(sequence(0, size(xs) - 1, {block}), i -> slice(xs, i + 1, {block}))"
    before = few("transform(parts, part -> part.now)")
    joined = f"parts -> flatten(zip_with(parts, {before}.out, (part, b) -> transform(part.out, v -> {merge('v', 'b')})))"
    body = f"get(transform(array(transform({blocks}, ys -> {few('ys')})), {joined}), 0)"
    return f"get(transform(array({array}), xs -> CASE WHEN size(xs) > 0 THEN {body} ELSE cast(array() AS array<int>) END), 0)"


def _gapped(pattern: str) -> str:
    """The pattern with the gap before it, from where the last match ended."""
    return rf"\G((?s:.*?))({pattern})"


def _found(text: Column, gapped: Column, group: int) -> Column:
    """All matches in order as structs of their places and the text of one of the pattern's groups (0: the match).

    gapped, from _gapped, matches the gap before each match along with it, so that lengths add up to places.
    """
    all_of = lambda k: f"regexp_extract_all(q.text, q.gapped, {k})"
    sizes = f"zip_with({all_of(1)}, {all_of(2)}, (g, m) -> named_struct('g', char_length(g), 'm', char_length(m)))"
    placed = f"zip_with(sizes, {_scan('transform(sizes, w -> w.g + w.m)', _sum)}, (w, at) -> named_struct('start', at + w.g, 'end', at + w.g + w.m))"
    places = f"get(transform(array({sizes}), sizes -> {placed}), 0)"
    found = f"q -> zip_with({places}, {all_of(2 + group)}, (p, value) -> named_struct('start', p.start, 'end', p.`end`, 'value', value))"
    return _of(F.struct(text.alias("text"), gapped.alias("gapped")), found)


def _window_span(value: Column, bits: Column) -> Column:
    """First and last window of the value whose entropy reaches bits, as a struct of their first characters; nulls if none.

    The entropy follows from the sum of c * log2(c) over the counts c of the window's characters. Counts are kept from
    window to window, a byte for each character from FIRST_CODE on, eight to a word: the one that enters adds to its
    byte, the one that leaves takes from its own, and the sum changes by these two counts alone.
    """
    g = [c * math.log2(c) if c else 0.0 for c in range(WINDOW + 1)]
    grown = "array(" + ", ".join(f"{b - a!r}D" for a, b in zip(g[:-1], g[1:], strict=True)) + ")"
    word = lambda code: f"shiftright({code}, 3)"
    lane = lambda code: f"shiftleft({code} & 7, 3)"
    one = lambda code: f"shiftleft(1L, {lane(code)})"
    count = lambda code: f"cast(shiftright(get(acc.counts, {word(code)}), {lane(code)}) & 255 AS int)"
    full, gone = f"acc.at >= {WINDOW}", f"get(q.codes, acc.at - {WINDOW})"
    # the first and last window that reaches bits, with the one that ends before the character to come
    here = f"CASE WHEN {full} AND acc.s <= q.most THEN acc.at - {WINDOW} END"
    noted = f"'first', coalesce(acc.`first`, {here}), 'last', coalesce({here}, acc.`last`)"
    entering = f"{count('code')} - CASE WHEN {full} AND {gone} = code THEN 1 ELSE 0 END"
    s = f"acc.s + get({grown}, {entering}) - CASE WHEN {full} THEN get({grown}, {count(gone)} - 1) ELSE 0.0D END"
    counts = f"transform(acc.counts, (w, k) -> w + CASE WHEN k = {word('code')} THEN {one('code')} ELSE 0L END - CASE WHEN {full} AND k = {word(gone)} THEN {one(gone)} ELSE 0L END)"
    start = f"named_struct('s', 0.0D, 'at', 0, 'first', cast(NULL AS int), 'last', cast(NULL AS int), 'counts', array_repeat(0L, {COUNT_WORDS}))"
    step = f"named_struct('s', {s}, 'at', acc.at + 1, {noted}, 'counts', {counts})"
    slid = f"q -> aggregate(q.codes, {start}, (acc, code) -> {step}, acc -> named_struct({noted}))"
    codes = F.expr(f"text -> transform(split(text, ''), c -> ascii(c) - {FIRST_CODE})")
    most = WINDOW * (F.lit(math.log2(WINDOW)) - bits) + F.lit(1e-9)
    return _of(F.struct(F.get(F.call_function("transform", F.array(value), codes), 0).alias("codes"), most.alias("most")), slid)


def _run_bits(value: Column) -> Column:
    return F.when(value.rlike("^[0-9a-fA-F]+$"), F.lit(HEX_BITS)).otherwise(F.lit(TEXT_BITS))


def _stretch(at: Column, value: Column, bits: Column, kind: int) -> Column:
    return F.struct(at.alias("start"), value.alias("value"), bits.alias("bits"), F.lit(kind).alias("kind"))


def _with_stretches(rows: DataFrame) -> DataFrame:
    """rows with _stretches, what of _wanted the window slides over: runs themselves, or, where allowed, what lies between
    their samples; and the stretches of their pieces that are of one of the alphabets of PIECES.

    A select for each step keeps functions from being nested, which the analysis of a query takes much time for.
    """
    mixed = lambda x: x.value.rlike("[0-9]") & x.value.rlike("[A-Za-z]")
    alphabets = F.array(*[F.struct(F.lit(_gapped(rf"[{chars}]{{{WINDOW},}}")).alias("gapped"), F.lit(bits).alias("bits")) for chars, bits in PIECES])
    inner = lambda of, found, made: F.flatten(F.transform(of, lambda x: F.transform(found(x), lambda y: made(x, y))))

    def piece(run: Column, p: Column) -> Column:
        return F.struct((run.start + p.start).alias("start"), p.value.alias("value"))

    def asked(p: Column, a: Column) -> Column:
        return F.struct(p.start.alias("start"), p.value.alias("value"), a.gapped.alias("gapped"), a.bits.alias("bits"))

    rest = lambda r: F.filter(_found(r.value, F.lit(_gapped(UNSAMPLED)), 0), lambda x: (F.char_length(x.value) >= WINDOW) & ~x.value.rlike(ALLOWED))
    beside = inner(F.filter("_wanted", lambda r: r.allowed), rest, lambda r, x: _stretch(r.start + x.start, x.value, _run_bits(x.value), 4))
    whole = F.transform(F.filter("_wanted", lambda r: ~r.allowed), lambda r: _stretch(r.start, r.value, _run_bits(r.value), 3))
    pieces = inner(F.col("_wanted"), lambda r: _found(r.value, F.lit(_gapped(rf"[0-9A-Za-z]{{{WINDOW},}}")), 0), piece)
    rows = rows.select("*", F.concat(whole, beside).alias("_whole"), F.filter(pieces, lambda p: mixed(p) & ~p.value.rlike(f"(?i:{SAMPLES})")).alias("_pieces"))
    rows = rows.select("*", inner(F.col("_pieces"), lambda p: alphabets, asked).alias("_asked"))
    of_pieces = inner(F.col("_asked"), lambda q: _found(q.value, q.gapped, 0), lambda q, x: _stretch(q.start + x.start, x.value, q.bits, 4))
    return rows.select("*", F.concat("_whole", F.filter(of_pieces, mixed)).alias("_stretches")).drop("_whole", "_pieces", "_asked")


#: SQL of spans in order -> of each one, the largest end of those before it.
LARGEST_BEFORE = _scan("transform(spans, x -> x.`end`)", _greatest)


def _longest_first(spans: str, rank: int) -> str:
    """SQL of spans that sort by start, and of those that begin together the longest first."""
    return f"transform({spans}, x -> named_struct('start', x.start, 'less', -x.`end`, 'rank', {rank}, 'kind', x.kind, 'end', x.`end`))"


def _kept(ends: str, test: str) -> str:
    """SQL of those of spans that pass a test of themselves (p.s) and of their place's value in ends (p.e), in order."""
    return f"transform(filter(zip_with(spans, {ends}, (s, e) -> named_struct('s', s, 'e', e)), p -> {test}), p -> named_struct('start', p.s.start, 'kind', p.s.kind, 'end', p.s.`end`))"


def _outermost(spans: Column) -> Column:
    """Distinct spans that lie in no other one, in order."""
    order = f"sort_array({_longest_first('q', 0)})"
    return _of(spans, f"q -> get(transform(array({order}), spans -> {_kept(LARGEST_BEFORE, 'p.s.`end` > p.e')}), 0)")


def _outside(spans: Column, others: Column) -> Column:
    """The spans that lie in none of the others, in order."""
    order = f"sort_array(concat({_longest_first('q.others', 0)}, {_longest_first('q.own', 1)}))"
    ends = _scan("transform(spans, s -> CASE WHEN s.rank = 0 THEN s.`end` ELSE 0 END)", _greatest)
    kept = _kept(ends, "p.s.rank = 1 AND p.s.`end` > p.e")
    return _of(F.struct(spans.alias("own"), others.alias("others")), f"q -> get(transform(array({order}), spans -> {kept}), 0)")


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m.start.alias("start"), F.lit(kind).alias("kind"), m.end.alias("end")))


NO_SPANS = "array<struct<start:int,kind:int,end:int>>"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with four more columns, arrays of (start, kind, end) by start and kind (the kind's place in KINDS).

    base_spans; run_spans, these and the entropy spans of whole runs; piece_spans; and secret_spans, all of them.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(body)
    named = low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token") | low.contains("api_key") | low.contains("apikey")
    rows = docs.select("*", named.alias("_named"), body.contains("AKIA").alias("_akia"), body.rlike("[0-9a-f]{32}").alias("_hex"), body.rlike(LONG_RUN).alias("_run"))
    none = F.array().cast(NO_SPANS)
    assign = F.when(F.col("_named"), _spans(F.filter(_found(body, F.lit(_gapped(ASSIGN)), 2), lambda m: F.char_length(m.value) >= 8), 0)).otherwise(none)
    access = F.when(F.col("_akia"), _spans(_found(body, F.lit(_gapped(ACCESS)), 0), 1)).otherwise(none)
    hexes = F.when(F.col("_hex"), _spans(_found(body, F.lit(_gapped(HEX)), 0), 2)).otherwise(none)
    rows = rows.select("*", F.sort_array(F.concat(assign, access, hexes)).alias("base_spans"))
    judge = lambda m: F.struct(m.start.alias("start"), m.end.alias("end"), m.value.alias("value"), m.value.rlike(ALLOWED).alias("allowed"), m.value.rlike(f"(?i:{SAMPLES})").alias("sample"))

    def outside_base(found: Column) -> Column:
        """The runs that lie in no base match; kind has their places among all."""
        spans = F.transform(found, lambda m, i: F.struct(m.start.alias("start"), i.alias("kind"), m.end.alias("end")))
        return F.transform(_outside(spans, F.col("base_spans")), lambda x: F.get(found, x.kind))

    judged = F.transform(_let(_found(body, F.lit(_gapped(LONG_RUN)), 0), outside_base), judge)

    wanted = F.filter(judged, lambda m: ~m.allowed | m.sample)
    no_runs = F.array().cast("array<struct<start:int,end:int,value:string,allowed:boolean,sample:boolean>>")
    rows = _with_stretches(rows.select("*", F.when(F.col("_run"), wanted).otherwise(no_runs).alias("_wanted")))
    slid = F.transform("_stretches", lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), _window_span(x.value, x.bits).alias("w")))
    rows = rows.select("*", F.filter(slid, lambda x: x.w.first.isNotNull()).alias("_slid"))
    hits = F.transform("_slid", lambda x: F.struct((x.start + x.w.first).alias("start"), x.kind.alias("kind"), (x.start + x.w["last"] + WINDOW).alias("end")))
    rows = rows.select("*", hits.alias("_hits"))
    of_kind = lambda kind: F.filter("_hits", lambda x: x.kind == kind)
    rows = rows.select("*", F.when(F.size("_hits") > 0, _outside(of_kind(3), F.col("base_spans"))).otherwise(none).alias("_extra"))
    rows = rows.select("*", F.sort_array(F.concat("base_spans", "_extra")).alias("run_spans"))
    pieces = _outside(_outermost(of_kind(4)), F.col("run_spans"))
    rows = rows.select("*", F.when(F.size("_hits") > 0, pieces).otherwise(none).alias("piece_spans"))
    rows = rows.select("*", F.sort_array(F.concat("run_spans", "piece_spans")).alias("secret_spans"))
    return rows.drop("_named", "_akia", "_hex", "_run", "_extra", "_wanted", "_stretches", "_slid", "_hits")


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each stretch of overlapping spans replaced by mark."""

    def cut(stretches: Column) -> Column:
        """stretches: the text that is kept before each mark, as a struct of begin and end; cut from blocks of the text."""

        def block(b: Column) -> Column:
            begin = F.get(b, 0).begin
            some = F.substring(text, begin + 1, F.element_at(b, -1).end - begin)
            return _let(some, lambda t: F.array_join(F.transform(b, lambda x: F.concat(F.substring(t, x.begin - begin + 1, x.end - x.begin), F.lit(mark))), ""))

        return F.array_join(F.transform(_blocks(stretches, F.ceil(F.sqrt(F.size(stretches))).cast("int")), block), "")

    def marked(x: Column) -> Column:
        kept = _of(x, f"spans -> filter(zip_with(spans, {LARGEST_BEFORE}, (s, e) -> named_struct('begin', e, 'end', s.start)), k -> k.`end` >= k.begin)")
        return F.concat(_let(kept, cut), F.substring(text, F.array_max(F.transform(x, lambda s: s.end)) + 1, F.char_length(text)))

    return F.when(F.size(spans) > 0, _let(_of(spans, f"q -> sort_array({_longest_first('q', 0)})"), marked)).otherwise(text)


def op5_secrets(docs: DataFrame) -> DataFrame:
    rows = scan(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s.kind == kind)).cast("long")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(as_text(F.col("base_spans")), 256).alias("base_sha256"), as_text(F.col("secret_spans")).alias("spans"), as_text(F.col("piece_spans")).alias("piece_spans")
    )
