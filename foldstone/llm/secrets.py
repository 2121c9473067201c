"""Secret scans with DataFrame functions only: patterns, and sliding-window entropy of candidate strings.

Patterns give base spans. Candidates are runs of a character class; over each, a window slides one character at a time. The
fold carries the window's counts, one place for each character of the class, and S, the sum of c * log2(c) over them: the
character that comes and the one that leaves each change one count and two terms of S, whatever the width, and
H = log2(W) - S / W. A candidate whose best window reaches the limit of its class is a span unless a base span holds it.
Stretches of the allow-list are cut out first, and a candidate is a span whole if any part left between them tells.

Positions are code points, ends exclusive. They come from the lengths of the matches and of the texts between them, so
nothing leaves the JVM and nothing is shuffled. A pattern passes over a text once, and once more where it has matches.

Defined cases: null and empty texts have no spans (``spans`` empty, its digest that of the empty string); an empty table gives
no rows; very long texts and candidates are scanned whole, a candidate in time proportional to its length; repeated rows are
scanned each. Other columns pass ``redact`` untouched whatever their names, ``n_chars`` where the text has no span or is null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.llm.text import fresh

#: Base patterns in the order of their kinds, the group that must reach a length, and that length.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 1, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32))
#: The same spans as ``BASE`` where a shorter run can never hold a longer one.
_FAST = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}

_SPAN = "array<struct<start:long,rank:int,end:long,kind:string>>"


@dataclass(frozen=True)
class EntropyClass:
    """Candidates ``pattern`` that also match every one of ``needs``; a window of ``width`` with ``least`` bits tells."""

    kind: str
    pattern: str
    needs: tuple[str, ...]
    width: int
    least: float


#: Hexadecimal digits; mixed letters and digits; and keys of one letter case, which need digits in three places.
CLASSES = (
    EntropyClass("hex_entropy", r"[0-9A-Fa-f]{24,}", (r"[0-9]", r"[A-Fa-f]"), 24, 3.0),
    EntropyClass("base64_entropy", r"[A-Za-z0-9+/_-]{20,}={0,2}", (r"[0-9]", r"[A-Z]", r"[a-z]"), 20, 3.7),
    EntropyClass("upper_entropy", r"[A-Z0-9]{26,}", (r"[G-Z]", r"(?:[0-9][A-Z]+){2}[0-9]"), 24, 3.5),
    EntropyClass("lower_entropy", r"[a-z0-9]{26,}", (r"[g-z]", r"(?:[0-9][a-z]+){2}[0-9]"), 24, 3.6),
)
#: The characters of all classes lie between these.
LOWEST, HIGHEST = ord("+"), ord("z")

#: Candidates that tell nothing: one pattern a line of reasons.
ALLOW = (
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|xxxx",  # stand-ins of documentation
    r"(?i)^(0123456789abcdef)+",  # counting
    r"(?i)abcdefghijklm",  # the alphabet
    r"(.)\1{7,}",  # one character over and over
    r"^(sha(1|256|384|512)|md5)[-_]",  # named digests
)

#: What an allowed stretch covers: a stand-in its own token, up to 32 letters and digits on each side; a named digest as
#: many characters as it has hexadecimal digits; else itself. The rest of a candidate is judged without it.
CUT = "|".join(
    (
        r"(.)\1{7,}",
        *(rf"^{name}[-_][A-Za-z0-9+/_-]{{0,{digits}}}" for name, digits in (("md5", 32), ("sha1", 40), ("sha256", 64), ("sha384", 96), ("sha512", 128))),
        r"(?i:^(?:0123456789abcdef)+)",
        r"(?i:abcdefghijklm(?:nopqrstuvwxyz)?(?:0123456789)?)",
        r"[A-Za-z0-9]{0,32}(?i:example|sample|dummy|placeholder|changeme|redacted|xxxx)[A-Za-z0-9]{0,32}",
    )
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _located(text: Column, pattern: str, kind: str, rank: int, keep) -> Column:
    """Spans of all leftmost matches of ``pattern`` for which ``keep(match)`` holds, in order."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["match"])
        span = F.struct(begin.cast("long").alias("start"), F.lit(rank).alias("rank"), end.cast("long").alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.cast("long").alias("at"), F.when(keep(pair["match"]), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    def placed(matches: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        pairs = F.zip_with(between, matches, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
        return F.when(F.size(matches) > 0, F.aggregate(pairs, start, step, lambda state: state["spans"])).otherwise(F.array().cast(_SPAN))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def base_spans(text: Column) -> Column:
    """Spans of the base patterns, by start, then by kind as listed."""
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        if kind in _FAST:
            parts.append(_located(text, _FAST[kind], kind, rank, lambda match: F.lit(True)))
        else:
            parts.append(_located(text, pattern, kind, rank, lambda match, p=pattern, g=group, n=least: F.length(F.regexp_extract(match, p, g)) >= n))
    return F.array_sort(F.concat(*parts))


def best_entropy(candidate: Column, width: int) -> Column:
    """The largest entropy, in bits, of a window of ``width`` characters sliding over ``candidate``.

    The counts are a string, one character a count, so that one of them is read or replaced in place."""
    weights = F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(width + 2)])
    codes = F.transform(F.split(candidate, ""), lambda c: F.ascii(c) - (LOWEST - 1))

    def moves(codes: Column) -> Column:
        """The code of each character that comes, and before it that of the one that leaves, negative."""
        return F.flatten(F.transform(codes, lambda c, i: F.when(i >= width, F.array(-F.element_at(codes, i - (width - 1)), c)).otherwise(F.array(c))))

    def step(state: Column, move: Column) -> Column:
        def changed(old: Column) -> Column:
            new = old + F.sign(move).cast("int")
            total = state["total"] - weights[old] + weights[new]
            come = state["come"] + (move > 0).cast("int")
            whole = (move > 0) & (come >= width)
            counts = F.overlay(state["counts"], F.char(new + ord("0")), F.abs(move), F.lit(1))
            least = F.when(whole, F.least(state["least"], total)).otherwise(state["least"])
            return F.struct(counts.alias("counts"), come.alias("come"), total.alias("total"), least.alias("least"))

        return _let(F.ascii(F.substring(state["counts"], F.abs(move), F.lit(1))) - ord("0"), changed)

    begin = F.struct(F.lit("0" * (HIGHEST - LOWEST + 1)).alias("counts"), F.lit(0).alias("come"), F.lit(0.0).alias("total"), F.lit(float("inf")).alias("least"))
    least = _let(codes, lambda codes: F.aggregate(moves(codes), begin, step, lambda state: state["least"]))
    return F.round(F.lit(log2(width)) - least / width, 9)


def _tells(match: Column, found: EntropyClass) -> Column:
    named = lambda x: reduce(lambda a, b: a & b, [x.rlike(p) for p in found.needs])
    allowed = reduce(lambda a, b: a | b, [match.rlike(p) for p in ALLOW])
    enough = lambda x: best_entropy(x, found.width) >= found.least
    rest = F.filter(F.split(match, CUT, -1), lambda x: (F.length(x) >= found.width) & named(x))
    return F.when(named(match), F.when(allowed, F.exists(rest, enough)).otherwise(enough(match))).otherwise(False)


def entropy_spans(text: Column) -> Column:
    parts = [_located(text, c.pattern, c.kind, len(BASE) + i, lambda match, c=c: _tells(match, c)) for i, c in enumerate(CLASSES)]
    return F.array_sort(F.concat(*parts))


def all_spans(base: Column, entropy: Column) -> Column:
    """Base spans, and those entropy spans that no base span holds whole."""
    new = F.filter(entropy, lambda e: ~F.exists(base, lambda b: (b["start"] <= e["start"]) & (b["end"] >= e["end"])))
    return F.array_sort(F.concat(base, new))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base spans by kind, their digest, and all spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base_spans(text).alias("base"), entropy_spans(text).alias("entropy"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    spans = _joined(all_spans(F.col("base"), F.col("entropy")))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k, *_ in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"))


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mask`` (overlapping spans by one), and ``n_chars`` to match.

    Rows whose text has no span, and those with a null text, are left as they are; no row goes.
    """
    base, entropy, spans, clean = fresh(docs, "base", "entropy", "spans", "clean")
    text = F.col("text")
    found = docs.withColumns({base: base_spans(F.coalesce(text, F.lit(""))), entropy: entropy_spans(F.coalesce(text, F.lit("")))})
    found = found.withColumn(spans, all_spans(F.col(base), F.col(entropy)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        joins = (span["start"] < state["at"]) & (state["at"] > 0)
        gap = text.substr((state["at"] + 1).cast("int"), F.greatest(span["start"] - state["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.when(joins, state["out"]).otherwise(F.concat(state["out"], gap, F.lit(mask))).alias("out"))

    rest = lambda state: F.concat(state["out"], text.substr((state["at"] + 1).cast("int"), F.length(text)))
    found = found.withColumn(clean, F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)))  # null: as it was
    swap = {"text": F.coalesce(F.col(clean), text)}
    if "n_chars" in docs.columns:
        swap["n_chars"] = F.coalesce(F.length(clean).cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return found.select(*[swap.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def oracle() -> str:
    """DuckDB SQL for ``scan_secrets``: the same spans, each window's entropy counted afresh."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        parts.append(f"select doc_id, {rank} rank, '{kind}' kind, start, start + length(m) stop, true base, m from located('{kind}', {q(pattern)}) where length(regexp_extract(m, {q(pattern)}, {group})) >= {least}")
    for i, c in enumerate(CLASSES):
        needs = " and ".join(f"regexp_matches(m, {q(p)})" for p in c.needs)
        allowed = " or ".join(_allowed_sql(p, q) for p in ALLOW)
        entropy = f"""(select max(round(log2({c.width}e0) - t / {c.width}, 9)) from (select (select sum(log2(cast(len(list_filter(w, lambda y: y = x)) as double))) from (select unnest(w) x)) t from (select string_split(substr(m, cast(i as bigint), {c.width}), '') w from (select unnest(range(1, length(m) - {c.width} + 2)) i))))"""
        parts.append(f"select doc_id, {len(BASE) + i} rank, '{c.kind}' kind, start, start + length(m) stop, false base, m from located('{c.kind}', {q(c.pattern)}) where {needs} and not ({allowed}) and length(m) >= {c.width} and {entropy} >= {c.least}")
    sources = []
    for kind, pattern in [(k, p) for k, p, _, _ in BASE] + [(c.kind, c.pattern) for c in CLASSES]:
        sources.append(f"""located_{kind} as (select doc_id, m, list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda g: length(g))), 0) start from
 (select doc_id, ms, gaps, unnest(ms) m, unnest(range(1, len(ms) + 1)) i from (select doc_id, regexp_extract_all(t, {q(pattern)}) ms, string_split_regex(t, {q(pattern)}) gaps from d)))""")
    body = "\nunion all ".join(parts)
    for kind in [k for k, *_ in BASE] + [c.kind for c in CLASSES]:
        pattern = next((p for k, p, _, _ in BASE if k == kind), None) or next(c.pattern for c in CLASSES if c.kind == kind)
        body = body.replace(f"located('{kind}', {q(pattern)})", f"located_{kind}")
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents),
{', '.join(sources)},
s as ({body}),
k as (select * from s where base or not exists (select 1 from s b where b.base and b.doc_id = s.doc_id and b.start <= s.start and b.stop >= s.stop)),
a as (select doc_id, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
 string_agg(kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, rank) filter (base) bs, string_agg(kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, rank) sp from k group by doc_id)
select doc_id, cast(coalesce(n_assign, 0) as bigint) n_assign, cast(coalesce(n_access, 0) as bigint) n_access, cast(coalesce(n_hex, 0) as bigint) n_hex,
 sha256(coalesce(bs, '')) base_sha256, coalesce(sp, '') spans from d left join a using (doc_id)"""


def _allowed_sql(pattern: str, q) -> str:
    if pattern == r"(.)\1{7,}":  # no back references there: any eight like characters in a row
        return "exists(select 1 from (select unnest(range(1, length(m) - 6)) i) where substr(m, cast(i as bigint), 8) = repeat(substr(m, cast(i as bigint), 1), 8))"
    return f"regexp_matches(m, {q(pattern)})"
