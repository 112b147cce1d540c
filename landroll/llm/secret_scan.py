"""Secret scan with corpus-wide ownership frequency, in built-in column expressions only.

Base spans are the leftmost non-overlapping matches of three fixed patterns over the whole text. A fourth
kind, mixed, collects long runs of letters and digits that no base span touches. Values of all candidates
are counted by the distinct owners and repositories that hold them: a value held by few owners looks live, one
copied widely is an example. Base spans are always kept; mixed ones are added only where they look live.

Work grows with a text's length and number of matches: running values over a text's spans are taken within blocks of spans and then
over the blocks, and a text is cut where spans lie by way of its pieces of 1,024 code points.

Positions are code points, ends exclusive. Defined results: a very long text is scanned and redacted whole, however many matches it has; a null or empty text has no spans, and the digest of
no spans is that of the empty string; null owners count as one owner of their own; equal rows give equal
rows; a null id is carried along; no documents give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landroll.llm.common import saved

#: Kinds in the order of the digest, their pattern, the group whose length counts, and its least length.
KINDS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
MIXED = r"[A-Za-z0-9+/_-]{24,}"
LIVE_OWNERS = 2  # a value that more owners hold is an example
LIVE_REPOSITORIES = 4

BLOCK_ITEMS = 128
PIECE = 1024

SPAN = "struct<start:int,kind:int,stop:int,value:string>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Use a value several times in an expression that computes it once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(items: Column, kind: str, first: Column, out: Callable[[Column, Column], Column], step: Callable[[Column, Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """out(value, item) of every item, where value is what `step` has made of the items before it, from `first` on.

    step(value, item) and join(value, value of later items) must agree, and `first` must change nothing. Arrays are grown within
    blocks of BLOCK_ITEMS items, and over the blocks; so no array is copied once per item.
    """
    blocks = F.transform(
        F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK_ITEMS).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda b: F.slice(items, b * BLOCK_ITEMS + 1, F.lit(BLOCK_ITEMS)),
    )
    totals = lambda all_blocks: F.transform(all_blocks, lambda block: F.aggregate(block, first, step))
    none = F.expr(f"cast(array() as array<{kind}>)")
    begin = F.struct(first.alias("now"), none.alias("before"))
    grow = lambda state, total: F.struct(join(state["now"], total).alias("now"), F.concat(state["before"], F.array(state["now"])).alias("before"))
    before = lambda all_blocks: F.aggregate(totals(all_blocks), begin, grow, lambda state: state["before"])

    def within(block: Column, start: Column) -> Column:
        more = lambda state, item: F.struct(step(state["now"], item).alias("now"), F.concat(state["before"], F.array(state["now"])).alias("before"))
        values = F.aggregate(block, F.struct(start.alias("now"), none.alias("before")), more, lambda state: state["before"])
        return F.zip_with(values, block, out)

    return _let(blocks, lambda all_blocks: F.flatten(F.zip_with(all_blocks, before(all_blocks), within)))


def _spans(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Array of (start, kind, stop, value), where value is the counted group; empty for most texts after one look."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")

    def span(at: Column, part: Column) -> Column:
        start = at + F.length(part["gap"])
        found = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(part["whole"])).alias("stop"), part["value"].alias("value"))
        return found.cast(SPAN)

    def located(whole: Column) -> Column:
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
        parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
        add = lambda at, part: (at + F.length(part["gap"]) + F.length(part["whole"])).cast("int")
        spans = _let(parts, lambda p: _running(p, "int", F.lit(0), span, add, lambda at, more: at + more))
        return F.filter(spans, lambda s: F.length(s["value"]) >= least)

    return F.when(text.rlike(pattern), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)).otherwise(none)


def base_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    return F.sort_array(F.concat(*(_spans(text, p, g, n, k) for k, (_, p, g, n) in enumerate(KINDS))))


def mixed_spans(text: Column, base: Column) -> Column:
    """Long runs with a capital, a small letter and a digit that touch no base span."""
    runs = _spans(F.coalesce(text, F.lit("")), MIXED, 0, 24, len(KINDS))
    varied = lambda s: s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]") & s["value"].rlike("[0-9]")
    return F.when(F.size(runs) > 0, _let(F.filter(runs, varied), lambda r: _apart(r, base))).otherwise(runs)


def _apart(runs: Column, base: Column) -> Column:
    """The runs that touch no base span: among all spans by start, no base span before reaches into one, none after starts in it."""
    is_run = lambda s: s["kind"] == len(KINDS)
    greatest = lambda a, b: F.greatest(a, b)
    marked = lambda free: lambda now, s: F.struct(s.alias("s"), (~is_run(s) | free(now, s)).alias("free"))
    kind = f"struct<s:{SPAN},free:boolean>"

    def clear(spans: Column) -> Column:
        reach = lambda now, s: F.when(is_run(s), now).otherwise(F.greatest(now, s["stop"]))
        ahead = _running(spans, "int", F.lit(-1), marked(lambda now, s: now <= s["start"]), reach, greatest)
        # backwards, with starts negated, the nearest base span to come is the greatest one
        coming = lambda now, m: F.when(is_run(m["s"]), now).otherwise(F.greatest(now, -m["s"]["start"]))
        both = lambda now, m: F.struct(m["s"].alias("s"), (m["free"] & (-now >= m["s"]["stop"])).alias("free")).cast(kind)
        back = _let(F.reverse(ahead), lambda m: _running(m, "int", F.lit(-(2**31) + 1), both, coming, greatest))
        return F.transform(F.filter(F.reverse(back), lambda m: is_run(m["s"]) & m["free"]), lambda m: m["s"])

    return F.when(F.size(base) > 0, _let(F.sort_array(F.concat(base, runs)), clear)).otherwise(runs)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in (*(k for k, *_ in KINDS), "mixed")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def _candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repository: Column) -> DataFrame:
    """Row number, id, owner, repository and spans of every document, values as hashes; written, so texts are read once."""
    secret = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), F.sha2(s["value"], 256).alias("value"))
    both = _let(base_spans(F.col(text_col)), lambda b: F.struct(F.transform(b, secret).alias("base"), F.transform(mixed_spans(F.col(text_col), b), secret).alias("mixed")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(owner_col), F.lit("\0")).alias("owner"), repository.alias("repository"), both.alias("both"))
    rows = rows.select("doc_id", "owner", "repository", "both.base", "both.mixed")
    return saved(rows.withColumn("row", F.monotonically_increasing_id()), "candidates")


def _live_values(rows: DataFrame, live_owners: int, live_repositories: int) -> DataFrame:
    """Per value: distinct owners and repositories, and whether it looks live. Pairs are made distinct before counting."""
    each = rows.select("owner", "repository", F.explode(F.concat("base", "mixed")).alias("s")).select("owner", "repository", F.col("s.value").alias("value"))
    owners = each.select("value", "owner").distinct().groupBy("value").agg(F.count("*").alias("owners"))
    places = each.select("value", "repository").distinct().groupBy("value").agg(F.count("*").alias("repositories"))
    both = owners.join(places, "value")
    return both.withColumn("live", (F.col("owners") <= live_owners) & (F.col("repositories") <= live_repositories))


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository: Column | None = None,
    live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES,
) -> DataFrame:
    """Per document: counts and digest of the base spans, all spans, and how many values look live or copied.

    repository: column expression of the repository; the owner and the first part of the id's range when None.
    """
    repository = F.coalesce(F.col(owner_col), F.lit("\0")) if repository is None else repository
    rows = _candidates(docs, id_col, text_col, owner_col, repository)
    values = saved(_live_values(rows, live_owners, live_repositories).select("value", "live"), "values")
    spans = rows.select("row", F.explode(F.concat("base", "mixed")).alias("s")).select("row", "s.start", "s.kind", "s.stop", "s.value").join(values, "value")
    mixed = len(KINDS)
    kept = F.struct("start", "kind", "stop")
    verdicts = spans.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when((F.col("kind") < mixed) | F.col("live"), kept))).alias("spans"),
        F.sum(F.col("live").cast("bigint")).alias("n_live"), F.sum((~F.col("live")).cast("bigint")).alias("n_copied"),
    )
    out = rows.join(verdicts, "row", "left")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return out.select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), F.coalesce(joined(F.col("spans")), F.lit("")).alias("spans"), zero("n_live"), zero("n_copied"),
    )


def _cut(pieces: Column, start: Column, stop: Column) -> Column:
    """The code points from start up to stop of a text given in pieces of PIECE code points."""
    def part(piece: Column) -> Column:
        begin = F.greatest(start - piece * PIECE, F.lit(0))
        return F.substring(F.get(pieces, piece), begin + 1, stop - piece * PIECE - begin)

    numbers = F.sequence(F.floor(start / PIECE).cast("int"), F.floor((stop - 1) / PIECE).cast("int"))
    return F.when(stop > start, F.array_join(F.transform(numbers, part), "")).otherwise("")


def _without(text: Column, spans: Column, mark: str) -> Column:
    """The text with every span replaced; overlapping spans are one. Spans are in order of their starts."""
    def cut(pieces: Column) -> Column:
        reach = lambda now, s: F.greatest(now, s["stop"])
        kept = lambda now, s: F.when(s["start"] >= now, F.concat(_cut(pieces, now, s["start"]), F.lit(mark))).otherwise("")
        end = F.array_max(F.transform(spans, lambda s: s["stop"]))
        return F.concat(F.array_join(_running(spans, "int", F.lit(0), kept, reach, F.greatest), ""), _cut(pieces, end, F.length(text)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _let(pieces, cut)).otherwise(text)


def redact_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository: Column | None = None,
    length_col: str | None = "n_chars", mark: str = "[SECRET]", live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES,
) -> DataFrame:
    """The documents with base spans and live-looking mixed spans replaced, lengths renewed, all columns kept.

    Texts stay where they are: only documents with mixed candidates meet the verdicts in a join. Rows without an id
    meet them by the hash of their text.
    """
    own_repository = F.coalesce(F.col(owner_col), F.lit("\0")) if repository is None else repository
    own_key = lambda known: F.struct(F.col(id_col).alias("id"), F.when(F.col(id_col).isNull() & known, F.sha2(text_col, 256)).alias("text"))
    runs = F.coalesce(F.col(text_col).rlike(MIXED), F.lit(False))
    keyed = docs.withColumn("__key", own_key(runs))
    rows = _candidates(keyed, "__key", text_col, owner_col, own_repository)
    values = saved(_live_values(rows, live_owners, live_repositories).where("live").select("value"), "values")
    live = rows.select("doc_id", F.explode("mixed").alias("s")).select("doc_id", "s.start", "s.kind", "s.stop", "s.value")
    live = live.join(values, "value").groupBy("doc_id").agg(F.collect_set(F.struct("start", "kind", "stop")).alias("__live"))
    live = live.select(F.coalesce(F.col("doc_id.id").cast("string"), F.lit("")).alias("__id"), F.coalesce("doc_id.text", F.lit("")).alias("__text"), "__live")
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    text = F.col(text_col)
    alone = docs.where(~runs).select(*docs.columns, plain(base_spans(text)).alias("__all"))
    same = (F.coalesce(F.col(id_col).cast("string"), F.lit("")) == F.col("__id")) & (F.when(F.col(id_col).isNull(), F.sha2(text_col, 256)).otherwise("") == F.col("__text"))
    some = docs.where(runs).join(live, same, "left")
    none = F.expr("cast(array() as array<struct<start:int,kind:int,stop:int>>)")
    # rows may repeat an id with another text, so a live span must be a candidate of this text as well
    # (compared as numbers, of which an intersection is one pass)
    packed = lambda c: F.transform(c, lambda s: F.shiftleft(s["start"].cast("bigint"), 32) + s["stop"])
    unpacked = lambda c: F.transform(c, lambda k: F.struct(F.shiftright(k, 32).cast("int").alias("start"), F.lit(len(KINDS)).alias("kind"), k.bitwiseAND(2**32 - 1).cast("int").alias("stop")))
    shared = lambda b: unpacked(F.array_intersect(packed(mixed_spans(text, b)), packed(F.coalesce(F.col("__live"), none))))
    every = _let(base_spans(text), lambda b: F.sort_array(F.concat(plain(b), shared(b))))
    out = alone.union(some.select(*docs.columns, every.alias("__all"))).withColumn(text_col, _without(text, F.col("__all"), mark))
    if length_col and length_col in docs.columns:
        length = F.length(text_col).cast(docs.schema[length_col].dataType)
        out = out.withColumn(length_col, F.when(F.size("__all") > 0, length).otherwise(F.col(length_col)))
    return out.select(*docs.columns)
