"""Secrets in texts, and multipart credentials linked by an interval join. DataFrame only.

Strong kinds stand alone: assigned secrets, access keys, long hex. Weak candidates (short
or vaguely named assignments, mixed bare tokens, account names, endpoints) are reported
only where complementary parts co-occur: a weak secret needs an identifier or endpoint,
and these need a secret, in the same scope (paragraph) and starting within ``reach``
characters.

Positions without a UDF: a text split by a pattern and the pattern's matches alternate, so
the running sum of their lengths gives each match's end in code points. Sums run in blocks,
over arrays that are computed once, and masked texts are put together from pieces, so both
stay near linear for texts with very many matches.

The join works on candidates of few documents, found by cheap filters. Parts are cut into
cells of ``reach`` characters; per (document, scope, side, cell) only the first and last
start are kept, which decide exactly whether a partner is in reach. So the join sees at
most three rows per candidate, never pairs. Its results, narrow rows of linked documents,
go back by a broadcast if their counted number allows, else by a shuffle.

Defined cases: a null or empty text has no spans; matches are leftmost and don't overlap
within a kind; kinds may overlap each other, but a weak candidate inside a stronger one is
left out; of equal rows each gets the same spans; rows with null ids are told apart by
their text; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from trustweave.llm.batches import name
from trustweave.llm.staging import staged

_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
#: Fixed patterns of the strong kinds.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))" + _VALUE + r"([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: The same matches of sufficient length, for texts where shorter ones don't matter.
LONG_ACCESS, LONG_HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
#: Weak candidates.
NAMED = r"(?i:(pwd|pass|passphrase|auth|credentials?|key|sig))" + _VALUE + r"([A-Za-z0-9+/_.=-]{6,})"
BARE = r"[A-Za-z0-9+/_-]{20,}"
IDENT = r"(?i:(user(?:name)?|login|account|client_?id|access_?key(?:_?id)?))" + _VALUE + r"([A-Za-z0-9+/_.@=-]{3,})"
ENDPOINT = r"(?i:https?|ftps?|wss?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s\"'<>]+"
BREAK = r"\n[\x20\t\r]*\n"

#: Kinds in their order; positions in this list number them.
KINDS = ("assign", "access", "hex", "weak", "ident", "endpoint")
MASK = "[SECRET]"
#: Linked documents (about 200 bytes each) that may be broadcast.
BROADCAST_ROWS = 200_000
_BLOCK = 256
#: Code points in a piece of a text that is masked.
_PIECE = 1024


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed one time, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, start: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running values of an array of long, block by block: appending to an array
    copies it, so arrays stay short until they are joined."""
    def run(array: Column, first: Column) -> Column:
        state = F.struct(first.alias("now"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(array, state, lambda a, v: F.struct(join(a["now"], v).alias("now"), F.array_append(a["out"], join(a["now"], v)).alias("out")), lambda a: a["out"])

    def long(array: Column) -> Column:
        n = F.ceil(F.size(array) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(array, k * _BLOCK + 1, _BLOCK))
        return once(blocks, lambda some: once(
            run(F.transform(some, lambda b: F.aggregate(b, start, join)), start),
            lambda ends: F.flatten(F.transform(some, lambda b, k: run(b, F.when(k == 0, start).otherwise(F.try_element_at(ends, F.greatest(k, F.lit(1))))))),
        ))

    return once(values, lambda array: F.when(F.size(array) == 0, F.array().cast("array<bigint>")).when(F.size(array) <= _BLOCK, run(array, start)).otherwise(long(array)))


def running_sum(values: Column) -> Column:
    """Inclusive running sums of an array of long."""
    return _running(values, F.lit(0).cast("bigint"), lambda a, v: a + v)


def located(rows: DataFrame, text: str, patterns: dict[str, tuple[Column, str]]) -> DataFrame:
    """Append for each name its matches (match, start, end), where its condition holds."""
    matches = rows.withColumns({f"__m_{k}": F.when(on, F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))) for k, (on, p) in patterns.items()})
    pieces = {k: F.slice(F.split(F.col(text), p, -1), 1, F.size(f"__m_{k}")) for k, (_, p) in patterns.items()}
    ends = {
        k: F.when(F.size(f"__m_{k}") > 0, running_sum(F.zip_with(pieces[k], f"__m_{k}", lambda a, b: (F.length(a) + F.length(b)).cast("bigint")))) for k in patterns
    }
    matches = matches.withColumns({f"__e_{k}": ends[k] for k in patterns})
    spans = {
        k: F.coalesce(
            F.zip_with(f"__m_{k}", f"__e_{k}", lambda m, e: F.struct(m.alias("match"), (e - F.length(m)).alias("start"), e.alias("end"))),
            F.array().cast("array<struct<match:string,start:bigint,end:bigint>>"),
        ) for k in patterns
    }
    return matches.withColumns(spans).drop(*[f"__{x}_{k}" for k in patterns for x in "me"])


def _contains_any(low: Column, *words: str) -> Column:
    out = low.contains(words[0])
    for w in words[1:]:
        out = out | low.contains(w)
    return out


def _strong(rows: DataFrame) -> DataFrame:
    """rows: text, low (its lower case). Appends __assign (short ones too), __access, __hex."""
    return located(rows, "text", {
        "__assign": (_contains_any(F.col("low"), "passw", "secret", "token", "api"), ASSIGN),
        "__access": (F.col("text").contains("AKIA"), LONG_ACCESS),
        "__hex": (F.lit(True), LONG_HEX),
    })


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _long_enough(spans: Column) -> Column:
    return F.filter(spans, lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 12)


def _key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart for linking; equal rows share it."""
    return F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit("\n"), text), 256)


def linked_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", reach: int = 256) -> DataFrame:
    """One row per document with linked weak candidates: key, linked (start, kind, end)."""
    rows = docs.select(name(doc_id).alias("doc_id"), name(text).cast("string").alias("text")).where("text IS NOT NULL")
    rows = rows.select("doc_id", "text", F.lower("text").alias("low"))
    may_name = _contains_any(F.col("low"), "user", "login", "account", "client", "access")
    partner = F.col("text").contains("AKIA") | F.col("text").contains("://") | may_name
    # both sides must be there before anything is located
    both = (F.col("text").rlike(ENDPOINT) | F.col("text").rlike(IDENT) | F.col("text").rlike(LONG_ACCESS)) & (
        F.col("text").rlike(ASSIGN) | F.col("text").rlike(LONG_HEX) | F.col("text").rlike(NAMED) | F.col("text").rlike(BARE))
    rows = rows.where(partner).where(both).select(_key(F.col("doc_id"), F.col("text")).alias("key"), "text", "low")
    found = located(_strong(rows), "text", {
        "__named": (F.lit(True), NAMED), "__bare": (F.lit(True), BARE), "__ident": (may_name, IDENT), "__endpoint": (F.col("text").contains("://"), ENDPOINT), "__break": (F.lit(True), BREAK),
    })
    mixed = F.filter("__bare", lambda s: s["match"].rlike("[0-9]") & s["match"].rlike("[A-Z]") & s["match"].rlike("[a-z]"))
    short = F.filter("__assign", lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) < 12)

    def ranked(spans: Column, kind: int, rank: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank")))

    strong = [ranked(_long_enough(F.col("__assign")), 0, 0), ranked(F.col("__access"), 1, 0), ranked(F.col("__hex"), 2, 0)]
    weak = [ranked(short, 3, 1), ranked(F.col("__named"), 3, 1), ranked(F.col("__ident"), 4, 1), ranked(F.col("__endpoint"), 5, 1), ranked(mixed, 3, 2)]
    parts = found.select("key", F.inline(F.concat(*strong, *weak, ranked(F.col("__break"), -1, 3))))

    # scopes, and whether a part lies in one of higher rank
    until = "PARTITION BY key ORDER BY start, rank, end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    after = "PARTITION BY key ORDER BY start DESC, rank DESC, end DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    seen = parts.select(
        "*", F.expr(f"coalesce(sum(int(kind = -1)) OVER ({until}), 0L)").alias("scope"),
        *[F.expr(f"max(CASE WHEN rank <= {r} THEN end END) OVER ({until})").alias(f"end{r}") for r in (0, 1)],
        *[F.expr(f"min(CASE WHEN rank <= {r} THEN start END) OVER ({after})").alias(f"next{r}") for r in (0, 1)],
    )
    within = F.expr("(rank = 1 AND (coalesce(end0 > start, false) OR coalesce(next0 < end, false))) OR (rank = 2 AND (coalesce(end1 > start, false) OR coalesce(next1 < end, false)))")
    cells = seen.where("kind >= 0").where(~within).select(
        "key", "scope", "start", "end", "kind", F.when(F.col("kind").isin(0, 2, 3), "secret").otherwise("partner").alias("side"), F.floor(F.col("start") / reach).alias("cell"),
    )
    cells = staged(cells, "parts")

    extents = cells.groupBy("key", "scope", "side", "cell").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    extents = extents.select("key", "scope", "side", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"), "first", "last")
    weak_parts = cells.where("kind >= 3").withColumn("side", F.when(F.col("side") == "secret", "partner").otherwise("secret"))
    near = weak_parts.join(extents, ["key", "scope", "side", "cell"]).where((F.col("first") - F.col("start") <= reach) & (F.col("start") - F.col("last") <= reach))
    return staged(near.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("linked")), "linked")


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", reach: int = 256) -> DataFrame:
    """Append ``base_spans`` and ``spans`` (base and linked ones) to all columns: arrays of
    (start, kind, end) in order, in code points, ends exclusive; kinds as in ``KINDS``."""
    linked = linked_spans(docs, doc_id=doc_id, text=text, reach=reach)
    n = linked.count()
    kept = [c for c in docs.columns if c.lower() not in ("base_spans", "spans")]
    rows = docs.select(F.struct(*[name(c) for c in kept]).alias("__doc"), F.coalesce(name(text).cast("string"), F.lit("")).alias("text"), name(doc_id).alias("doc_id"))
    rows = _strong(rows.withColumn("low", F.lower("text")))
    strong = F.concat(_of_kind(_long_enough(F.col("__assign")), 0), _of_kind(F.col("__access"), 1), _of_kind(F.col("__hex"), 2))
    rows = rows.select("__doc", "doc_id", "text", F.array_sort(strong).alias("base_spans"))
    if n:
        rows = rows.withColumn("key", _key(F.col("doc_id"), F.col("text")))
        rows = rows.join(F.broadcast(linked) if n <= BROADCAST_ROWS else linked, "key", "left")
        spans = F.when(F.col("linked").isNull(), F.col("base_spans")).otherwise(F.array_sort(F.concat("base_spans", "linked")))
    else:
        spans = F.col("base_spans")
    return rows.select(*[F.col("__doc")[c].alias(c) for c in kept], "base_spans", spans.alias("spans"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """Code points of a text from its pieces: only those at hand are read."""
    piece = lambda k: F.get(pieces, k)
    first, last = (start / _PIECE).cast("int"), ((end - 1) / _PIECE).cast("int")
    at = (start - first * _PIECE + 1).cast("int")
    one = F.substring(piece(first), at, (end - start).cast("int"))
    more = F.concat(
        F.substring(piece(first), at, F.lit(_PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        F.substring(piece(last), F.lit(1), (end - last * _PIECE).cast("int")),
    )
    return F.when(end <= start, "").when(first == last, one).otherwise(more)


def masked(text: Column, spans: Column) -> Column:
    """The text with each stretch of spans, overlapping ones as one, replaced by a mark.

    The text is cut into pieces once, and what stands between two stretches is read from the
    pieces at hand, so the work is linear in the text and its spans.
    """
    zero = F.lit(0).cast("bigint")

    def joined(own: Column, pieces: Column, length: Column) -> Column:
        reach = _running(F.transform(own, lambda s: s["end"]), zero, lambda a, v: F.greatest(a, v))
        return once(reach, lambda ends: F.concat(
            F.array_join(F.flatten(F.zip_with(own, F.concat(F.array(zero), F.slice(ends, 1, F.size(ends) - 1)), lambda s, before: F.when(
                s["start"] >= before, F.array(_cut(pieces, before, s["start"]), F.lit(MASK)),
            ).otherwise(F.array().cast("array<string>")))), ""),
            _cut(pieces, F.element_at(ends, -1), length),
        ))

    cut = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _PIECE), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(
        once(spans, lambda own: once(cut, lambda pieces: once(F.char_length(text).cast("bigint"), lambda n: joined(own, pieces, n))))
    )


def mask_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All rows and columns of ``docs``, secrets in the text masked; null texts stay null."""
    found = scan(docs, doc_id=doc_id, text=text, **options)
    own = name(text)
    return found.select(*[F.when(own.isNotNull(), masked(own, F.col("spans"))).alias(c) if c == text else name(c) for c in docs.columns])
