"""Secret scanning with multipart credential linking, in DataFrame functions only.

Strong parts stand alone: an assigned secret, an access key id, a long hex run. Weak parts (a short
assigned value, a bare token, an identifier, an endpoint) mean little alone; they are reported only
where complementary parts share their scope: two parts do if their starts are at most SCOPE code points
apart. That interval join is a merge of sorted spans within the row that holds the text: no shuffle, and
no key that could grow hot. Whatever runs along a row's spans does so in chunks of the square root of
their number, so a text with very many matches never costs their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsgraph.llm.common import chunks, let, packed, running, unpacked

# The base kinds, in the order in which spans of equal start are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{16,})"
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

#: The weak kinds. A bare token is a run that would do as a 40-character key.
IDENT = r"""(?i)(access_?key_?id|client_?id|username|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)"""
BARE = r"([A-Za-z0-9+/]{40,})"
ENDPOINT = r"(https?://[A-Za-z0-9.-]+)"
ASSIGN_WEAK, ACCESS_WEAK, IDENT_LEAST = 6, 12, 4
SCOPE = 256

KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
SPANS = "array<struct<start:int,kind:int,end:int>>"
MARK = "[REDACTED]"
_FAR = 1 << 30


def _matches(text: Column, pattern: str, group: int) -> Column:
    """All leftmost non-overlapping matches, as array<struct<start,size,end>> in code points; size is that of the group.

    What lies between matches (split) and the matches themselves alternate, so a running sum of their
    lengths gives the places; it runs only on texts that have a match.
    """
    p = F.lit(pattern)
    sizes = F.zip_with(F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group)), lambda m, v: F.struct(F.length(m).alias("n"), F.length(v).alias("v")))
    steps = let(sizes, lambda z: F.zip_with(z, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(z)), lambda s, g: F.struct((F.length(g) + s["n"]).alias("step"), s["n"].alias("n"), s["v"].alias("v"))))
    ends = lambda s: running(F.transform(s, lambda x: x["step"]), F.lit(0), lambda a, x: a + x)
    found = let(steps, lambda s: F.zip_with(ends(s), s, lambda e, x: F.struct((e - x["n"]).alias("start"), x["v"].alias("size"), e.alias("end"))))
    kind = "array<struct<start:int,size:int,end:int>>"
    return F.when(F.rlike(text, p), found.cast(kind)).otherwise(F.array().cast(kind))


def _spans(matches: Column, kind: str, least: int, below: int | None = None) -> Column:
    kept = F.filter(matches, lambda m: (m["size"] >= least) & (m["size"] < below) if below else m["size"] >= least)
    return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"))).cast(SPANS)


def _clear(weak: Column, base: Column) -> Column:
    """The weak spans that overlap no span of base: along all starts of base and ends of weak, the furthest end of base so far is looked at."""
    event = lambda at, own, start, kind: F.struct(at.alias("at"), F.lit(own).alias("own"), start.alias("x"), kind.alias("kind"))
    events = F.array_sort(F.concat(F.transform(weak, lambda w: event(w["end"], 0, w["start"], w["kind"])), F.transform(base, lambda b: event(b["start"], 1, b["end"], b["kind"]))))
    furthest = lambda e: running(F.transform(e, lambda x: F.when(x["own"] == 1, x["x"]).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    told = let(events, lambda e: F.zip_with(e, furthest(e), lambda x, end: F.struct(x.alias("e"), ((x["own"] == 0) & (end <= x["x"])).alias("keep"))))
    return F.transform(F.filter(told, lambda x: x["keep"]), lambda x: F.struct(x["e"]["x"].alias("start"), x["e"]["kind"].alias("kind"), x["e"]["at"].alias("end"))).cast(SPANS)


def _linked(spans: Column) -> Column:
    """Of sorted spans, the strong ones and those weak ones whose complement starts within SCOPE, before or after."""
    strong, named = len(KINDS) - 3, lambda x, *kinds: x["kind"].isin([KINDS.index(k) for k in kinds])
    places = lambda s, none: F.transform(s, lambda x: F.struct(F.when(named(x, "access", "ident"), x["start"]).otherwise(none).alias("i"), F.when(named(x, "assign", "hex", "secret"), x["start"]).otherwise(none).alias("s")))
    nearest = lambda p, none, pick: running(p, F.struct(F.lit(none).alias("i"), F.lit(none).alias("s")), lambda a, x: F.struct(pick(a["i"], x["i"]).alias("i"), pick(a["s"], x["s"]).alias("s")))
    back = lambda s: nearest(places(s, -_FAR), -_FAR, F.greatest)
    on = lambda s: F.reverse(nearest(places(F.reverse(s), _FAR), _FAR, F.least))

    def keep(x: Column, b: Column, o: Column) -> Column:
        ident, secret = ((x["start"] - b[c] <= SCOPE) | (o[c] - x["start"] <= SCOPE) for c in ("i", "s"))
        return (x["kind"] < strong) | (named(x, "ident") & secret) | (named(x, "secret") & ident) | (named(x, "endpoint") & ident & secret)

    told = F.zip_with(F.zip_with(spans, back(spans), lambda x, b: F.struct(x.alias("x"), b.alias("b"))), on(spans), lambda y, o: F.struct(y["x"].alias("x"), keep(y["x"], y["b"], o).alias("keep")))
    return F.transform(F.filter(told, lambda t: t["keep"]), lambda t: t["x"]).cast(SPANS)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with secret_base and secret_spans: arrays of (start, kind, end), sorted; kind counts in KINDS, ends are exclusive.

    secret_base has the strong parts, secret_spans those and the weak parts whose complement is in scope:
    identifiers with a secret, secrets with an identifier, endpoints with both. A weak part that overlaps
    a strong one is not reported again. A null text is an empty text; an empty one has no spans. Other
    columns and repeated rows stay as they are; columns of these two names are replaced.
    """
    own = packed(docs, _t=F.coalesce(F.col(text), F.lit("")))
    raw = own.select("_row", *(_matches(F.col("_t"), p, g).alias(f"_{n}") for n, p, g in (("assign", ASSIGN, 2), ("access", ACCESS, 1), ("hex", HEX, 1), ("ident", IDENT, 2), ("bare", BARE, 1), ("endpoint", ENDPOINT, 1))))
    strong = raw.select(
        "_row",
        _spans(F.col("_assign"), "assign", ASSIGN_LEAST).alias("_a"),
        _spans(F.col("_access"), "access", ACCESS_LEAST).alias("_k"),
        _spans(F.col("_hex"), "hex", 0).alias("_h"),
        F.concat(_spans(F.col("_access"), "ident", ACCESS_WEAK, ACCESS_LEAST), _spans(F.col("_ident"), "ident", IDENT_LEAST)).alias("_i"),
        F.concat(_spans(F.col("_assign"), "secret", ASSIGN_WEAK, ASSIGN_LEAST), _spans(F.col("_bare"), "secret", 0)).alias("_s"),
        _spans(F.col("_endpoint"), "endpoint", 0).alias("_e"),
    )
    base = strong.select("_row", F.array_sort(F.concat("_a", "_k", "_h")).alias("_base"), F.concat("_i", "_s", "_e").alias("_weak"))
    linked = lambda b: let(F.array_sort(F.concat(b, let(F.col("_weak"), lambda w: _clear(w, b)))), _linked)
    return unpacked(base, docs, secret_base="_base", secret_spans=F.when(F.size("_weak") > 0, let(F.col("_base"), linked)).otherwise(F.col("_base")))


def listed(spans: str | Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def counted(spans: str | Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """docs with MARK in place of each run of found spans; size, if it is a column, is counted anew where a text changed."""
    found = find(packed(docs, _text=F.col(text)), "_text")
    reach = lambda s: running(F.transform(s, lambda x: x["end"]), F.lit(0), lambda a, x: F.greatest(a, x))
    first = lambda s, r: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] > F.get(r, i - 1)))
    run = lambda s, r, h: F.transform(h, lambda i, k: F.struct(F.get(s, i)["start"].alias("start"), F.get(r, F.coalesce(F.get(h, k + 1), F.size(s)) - 1).alias("end")))
    merged = let(F.col("secret_spans"), lambda s: let(reach(s), lambda r: let(first(s, r), lambda h: run(s, r, h))))
    runs = found.select("_row", "_text", F.when(F.size("secret_spans") > 0, merged).alias("_runs"))
    begins = lambda r: F.concat(F.array(F.lit(0)), F.transform(r, lambda x: x["end"]))
    ends = lambda r: F.concat(F.transform(r, lambda x: x["start"]), F.array(F.length("_text")))
    kept = let(F.col("_runs"), lambda r: F.zip_with(begins(r), ends(r), lambda b, e: F.struct(b.alias("b"), e.alias("e"))))
    part = lambda c: let(F.get(c, F.lit(0))["b"], lambda at: let(F.substring(F.col("_text"), at + 1, F.element_at(c, -1)["e"] - at), lambda own: F.transform(c, lambda x: F.substring(own, x["b"] - at + 1, x["e"] - x["b"]))))
    pieces = F.flatten(F.transform(let(kept, chunks), part))  # a place is searched for from the start of its chunk, not of the text
    clean = runs.select("_row", F.col("_runs").isNotNull().alias("_changed"), F.when(F.col("_runs").isNotNull(), F.array_join(pieces, MARK)).otherwise(F.col("_text")).alias("_text"))
    results = {text: F.col("_text")}
    if size and size in docs.columns:
        results[size] = F.when(F.col("_changed"), F.length("_text").cast(docs.schema[size].dataType)).otherwise(F.col("_row").getField(size))
    return unpacked(clean, docs, **results).select(*(F.col(f"`{c}`") for c in docs.columns))
