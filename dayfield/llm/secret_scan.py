"""Operator 1: secrets in whole texts, by patterns and by sliding-window entropy."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds, in the order in which equal starts are listed: (kind, Java pattern, group to measure, least length).
BASE = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Runs that can fail only by length are searched with the length in the pattern; the longest runs are the same.
SEARCH = {"assign": BASE[0][1], "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: Entropy classes: (class, candidate pattern, alphabet, window, least bits per character).
CLASSES = (
    ("hexclass", r"[0-9A-Fa-f]{20,}", "0123456789abcdef", 20, 2.75),
    ("base64", r"[A-Za-z0-9+/_-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", 20, 3.6),
)
#: Runs that match one of these as a whole are not secrets.
ALLOW = (
    r"^[A-Za-z/_+-]*$",  # no digit: words, paths and identifiers
    r"^[0-9/_+-]*$",  # no letter: numbers, dates, rulers
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
)
#: Slugs, paths and dated names, which are no secrets either: runs of two parts or more, each of these letters or these few digits. A
#: pattern for the whole run would repeat a group, and the pattern engine recurses once for each repeat; parts are matched one by one.
BETWEEN, SLUG_PART = r"[/_+-]+", r"^(?:[A-Za-z]+|[0-9]{1,4})$"
#: Stretches that hold one of these are not secrets; what else their run holds is judged by itself.
ALLOW_WORDS = (
    r"(?i)example|placeholder|changeme|dummy|sample|redacted|xxxx|lorem",
    r"(?i)0123456789|abcdefghij",  # alphabets
)
SCALE = 10_000


def _terms(window: int) -> list[int]:
    """c * log2 c for c = 0..window in fixed point, so that sums are exact and independent of their order."""
    return [0] + [round(SCALE * c * math.log2(c)) for c in range(1, window + 1)]


#: Items handled together, so that arrays grow by pieces: the work on m matches is m^2 / PIECE at most, on small numbers.
PIECE = 64


def _pieces(items: Column) -> Column:
    """An array as an array of arrays of up to PIECE items."""
    n = F.ceil(F.size(items) / PIECE).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.slice(items, k * PIECE + 1, PIECE))).otherwise(F.slice(F.array(items), 1, 0))


def _found(text: Column, pattern: str) -> Column:
    """array<(start, end, value)> of leftmost non-overlapping matches; offsets in code points.

    Lengths of the matches and of the text between them add up to the offsets: first by piece, then inside each piece."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.zip_with(values, between, lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    pieces = _pieces(F.filter(pairs, lambda p: p["value"].isNotNull()))
    size = lambda ps: F.aggregate(ps, F.lit(0), lambda s, p: s + p["gap"] + F.length(p["value"]))

    def add(state: Column, pair: Column) -> Column:
        at = state["at"] + pair["gap"]
        end = at + F.length(pair["value"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(at.alias("start"), end.alias("end"), pair["value"].alias("value")))).alias("out"))

    def placed(ps: Column) -> Column:
        sizes = F.transform(ps, size)
        based = F.transform(ps, lambda p, k: F.struct(p.alias("p"), k.alias("k")))

        def spans(piece: Column, sizes: Column) -> Column:
            start = F.struct(F.aggregate(F.slice(sizes, 1, piece["k"]), F.lit(0), lambda s, x: s + x).alias("at"), _empty().alias("out"))
            return F.aggregate(piece["p"], start, add, lambda s: s["out"])

        return _bound_to(sizes, lambda z: F.flatten(F.transform(based, lambda piece: spans(piece, z))))

    return _bound_to(pieces, placed)


def _empty() -> Column:
    return F.array().cast("array<struct<start:int,end:int,value:string>>")


def base_spans(text: Column, kind: str) -> Column:
    pattern, group, least = next((p, g, n) for k, p, g, n in BASE if k == kind)
    gate = F.contains(text, F.lit("AKIA")) if kind == "access" else F.rlike(text, F.lit(SEARCH[kind]))
    found = _found(text, SEARCH[kind])
    if group:
        found = F.filter(found, lambda x: F.length(F.regexp_extract(x["value"], pattern, group)) >= least)
    return F.when(gate, found).otherwise(_empty())


def _bound_to(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, though ``use`` names it inside a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def _hot_windows(value: Column, alphabet: str, window: int, bits: float) -> Column:
    """array<(start, end)>: unions of the windows of ``value`` whose entropy reaches ``bits``.

    The state holds a count per character and the sum of c log c; entering and leaving characters change one count each.
    Entropy = log2 w - sum / w, so the test is an integer bound on the sum."""
    terms = F.array(*map(F.lit, _terms(window)))
    bound = math.floor(SCALE * window * (math.log2(window) - bits))
    folded = F.lower(value) if alphabet == "0123456789abcdef" else value
    codes = F.transform(F.slice(F.split(folded, ""), 1, F.length(value)), lambda c: F.call_function("locate", c, F.lit(alphabet)))
    steps = _bound_to(codes, lambda cs: F.transform(cs, lambda c, i: F.struct(c.alias("new"), F.when(i >= window, F.get(cs, i - window)).alias("old"), i.alias("at"))))
    zero = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0).alias("total"),
        F.array().cast("array<struct<start:int,end:int>>").alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end"),
    )

    def step(s: Column, x: Column) -> Column:
        same = x["old"].isNotNull() & (x["old"] == x["new"])
        entering, leaving = F.element_at(s["counts"], x["new"]), F.element_at(s["counts"], F.coalesce(x["old"], F.lit(1)))
        total = F.when(same, s["total"]).otherwise(
            s["total"] + F.get(terms, entering + 1) - F.get(terms, entering) - F.when(x["old"].isNotNull(), F.get(terms, leaving) - F.get(terms, leaving - 1)).otherwise(0)
        )
        counts = F.when(same, s["counts"]).otherwise(F.transform(s["counts"], lambda c, i: c + F.when(i == x["new"] - 1, 1).otherwise(0) - F.when(i == x["old"] - 1, 1).otherwise(0)))
        hot = (x["at"] >= window - 1) & (total <= bound)
        first = x["at"] - (window - 1)
        joins = s["end"] >= first
        done = F.when(hot & ~joins & (s["start"] >= 0), F.concat(s["done"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["done"])
        return F.struct(counts.alias("counts"), total.alias("total"), done.alias("done"), F.when(hot & ~joins, first).otherwise(s["start"]).alias("start"), F.when(hot, x["at"] + 1).otherwise(s["end"]).alias("end"))

    last = lambda s: F.when(s["start"] >= 0, F.concat(s["done"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["done"])
    return F.aggregate(steps, zero, step, last)


def _allowed(value: Column, patterns: tuple[str, ...]) -> Column:
    return F.array_contains(F.array(*(F.rlike(value, F.lit(p)) for p in patterns)), True)


def _slug(value: Column) -> Column:
    parts = F.split(value, BETWEEN, -1)
    return (F.size(parts) > 1) & F.forall(parts, lambda p: F.rlike(p, F.lit(SLUG_PART)))


def _class_spans(text: Column, pattern: str, alphabet: str, window: int, bits: float) -> Column:
    def stretches(run: Column) -> Column:
        return F.transform(
            _hot_windows(run["value"], alphabet, window, bits),
            lambda y: F.struct((run["start"] + y["start"]).alias("start"), (run["start"] + y["end"]).alias("end"), F.substring(run["value"], y["start"] + 1, y["end"] - y["start"]).alias("value")),
        )

    runs = F.filter(_found(text, pattern), lambda x: ~(_allowed(x["value"], ALLOW) | _slug(x["value"])))
    hot = F.filter(F.flatten(F.transform(runs, stretches)), lambda x: ~_allowed(x["value"], ALLOW_WORDS))
    return F.when(F.rlike(text, F.lit(pattern)), hot).otherwise(_empty())


def _outside(spans, others: Column) -> Column:
    """The spans that no span of ``others`` holds whole. Others are sorted and looked up by pieces with their first start and last end."""
    pieces = F.transform(_pieces(F.array_sort(F.transform(others, lambda y: F.struct(y["start"], y["end"])))), lambda p: F.struct(p.alias("p"), p[0]["start"].alias("lo"), F.array_max(F.transform(p, lambda y: y["end"])).alias("hi")))

    def held(x: Column, piece: Column) -> Column:
        return (piece["lo"] <= x["start"]) & (x["end"] <= piece["hi"]) & F.exists(piece["p"], lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]))

    return F.when(F.size(spans) > 0, _bound_to(pieces, lambda ps: F.filter(spans, lambda x: ~F.exists(ps, lambda p: held(x, p))))).otherwise(_empty())


def _tagged(spans, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"], F.lit(rank).alias("rank"), x["end"], F.lit(kind).alias("kind"), x["value"]))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: array<(start, rank, end, kind, value)> in order of start, then kind.

    Kinds: assign, access and hex are the base patterns; "entropy" are stretches found by window entropy that do not lie inside one
    base span (they may overlap one: its part is then reported by both). Offsets count code points, ends are exclusive. Null and
    empty texts have no secrets; texts are read whole, whatever their length; repeated rows are scanned each; other columns pass
    through, whatever their names, and an existing column ``secrets`` is replaced. One pass, no shuffle."""
    kept = [c for c in docs.columns if c != "secrets"]
    rows = docs.select(F.struct(*kept).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _scanned(rows).select("row.*", "secrets")


def _scanned(rows: DataFrame) -> DataFrame:
    """Adds secrets to rows with a text that is not null and no other columns but ``row``."""
    text = F.col("text")
    found = rows.withColumns({kind: base_spans(text, kind) for kind, *_ in BASE} | {name: _class_spans(text, *rule) for name, *rule in CLASSES})
    found = found.withColumn("base", F.concat(*(F.col(k) for k, *_ in BASE)))
    fresh = F.concat(_outside(F.col("hexclass"), F.col("base")), _outside(F.col("base64"), F.concat("base", "hexclass")))
    tagged = [_tagged(k, i, k) for i, (k, *_) in enumerate(BASE)]
    tagged.append(_tagged(fresh, len(BASE), "entropy"))
    return found.withColumn("secrets", F.array_sort(F.concat(*tagged))).select(*rows.columns, "secrets")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret replaced by [KIND]; overlapping secrets become one mark, that of the first.

    Columns stay as they are, whatever their names, but for the text and, if there is one, n_chars (its new length). Null texts
    stay null, empty ones empty; repeated rows stay; an empty table gives no rows. Texts are put together by pieces of spans."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    zero = lambda at: F.struct(at.alias("at"), F.array().cast("array<string>").alias("out"))

    def add(s: Column, x: Column) -> Column:
        new = x["start"] >= s["at"]
        mark = F.concat(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(new, F.concat(s["out"], F.array(mark))).otherwise(s["out"]).alias("out"))

    def part(s: Column, piece: Column) -> Column:
        done = F.aggregate(piece, zero(s["at"]), add)
        return F.struct(done["at"].alias("at"), F.concat(s["out"], F.array(F.array_join(done["out"], ""))).alias("out"))

    clean = F.aggregate(_pieces(F.col("secrets")), zero(F.lit(0)), part, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    marked = F.size("secrets") > 0
    out = _scanned(rows).select("row", marked.alias("marked"), F.when(marked, clean).alias("clean"))
    new = F.col("row").withField(text_col, F.when(F.col("marked"), F.col("clean")).otherwise(F.col("row").getField(text_col)))
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.when(F.col("marked"), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return out.select(new.alias("row")).select("row.*")
