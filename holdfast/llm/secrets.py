"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Three fixed shapes give the base findings.  A wider shape, a long token that mixes small letters,
capitals and digits, gives further candidates.  The hashes of all found values are counted over the
corpus by distinct repositories and owners: a value that more than ``MAX_OWNERS`` owners or more than
``MAX_REPOSITORIES`` repositories hold is a widely copied example, one that fewer hold is specific to its owner and
looks live.  Wider candidates are reported, as kind ``owned``, only if they look live and are outside the base
findings.  Every finding carries both counts.

The distinct (value, owner, repository) rows are reduced before anything is keyed by the value alone,
and values are joined to their counts row by row, so a value held by a third of all rows is never
gathered in one task.  The work on a text grows with its length, however many matches it has: offsets come from sums
over runs of parts that are made once, and findings of one text are compared in order of their starts.

Spans are of code points, end exclusive.  Defined results: a null text counts as empty and has no spans;
null owners and repositories count as one unknown each; repeated rows each get the same findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.plans.store import TableStore

# The base shapes in their order, with the group to measure and its least length.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LENGTH = 12
# A run of one class is matched whole from its first character, so the least length can be in the shape.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

OWNED = r"[A-Za-z0-9+/_-]{20,}"
MAX_OWNERS = 2
MAX_REPOSITORIES = 6
_MARK, _OTHER = "\u0001", "\u0002"
_RUN = 256
_SPAN = "struct<start:bigint,kind:int,end:bigint,value:bigint>"
_JUDGED = "struct<start:bigint,kind:int,end:bigint,owners:bigint,repositories:bigint,copied:boolean>"


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed a single time, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def _starts(lengths: Column) -> Column:
    """Running sums before each element: sums within a group of elements, on top of those of the groups before."""
    zero, add = F.lit(0).cast("bigint"), lambda a, b: a + b

    def grouped(all_: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(all_) - 1) / _RUN)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(all_, i * _RUN + 1, _RUN))

    def summed(groups: Column) -> Column:
        sums = F.transform(groups, lambda group: F.aggregate(group, zero, add))
        return F.struct(groups.alias("groups"), sums.alias("sums"))

    def placed(held: Column) -> Column:
        return F.flatten(F.transform(held["groups"], lambda group, i: _once(
            F.aggregate(F.slice(held["sums"], F.lit(1), i), zero, add),
            lambda ahead: F.transform(group, lambda _, j: ahead + F.aggregate(F.slice(group, F.lit(1), j), zero, add)),
        )))

    return _once(lengths, lambda all_: _once(grouped(all_), lambda groups: _once(summed(groups), placed)))


def _found(text: Column, shape: str, kind: int, value, keep) -> Column:
    """Spans of the matches of a shape: (start, kind, end, value hash)."""
    # Split at marks around the matches, every second part is one.
    parts = F.split(F.regexp_replace(text, shape, f"{_MARK}$0{_MARK}"), _MARK, -1)
    lengths = lambda p: F.transform(p, lambda x: F.char_length(x).cast("bigint"))

    def spans(held: Column) -> Column:
        part, start = held["parts"], held["starts"]
        places = F.sequence(F.lit(2), F.size(part) - 1, F.lit(2))
        every = F.transform(places, lambda i: F.struct(
            F.element_at(start, i).alias("start"),
            F.lit(kind).alias("kind"),
            (F.element_at(start, i) + F.char_length(F.element_at(part, i))).alias("end"),
            F.when(keep(F.element_at(part, i)), F.xxhash64(value(F.element_at(part, i)))).alias("value"),
        ))
        return F.filter(every, lambda s: s["value"].isNotNull())

    found = _once(parts, lambda p: _once(F.struct(p.alias("parts"), _starts(lengths(p)).alias("starts")), spans))
    return F.when(text.rlike(shape), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def candidates(df: DataFrame, doc_id: str, text: str, owner: str, repository: Column) -> DataFrame:
    """Base and wider findings of every row: row, doc_id, owner, repository, assign, runs (access and hex), wider."""
    rows = df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(owner).alias("owner"),
        F.xxhash64(repository).alias("repository"),
        # The mark is not part of any shape, and its stand-in has the same length.
        F.translate(F.coalesce(F.col(text), F.lit("")), _MARK, _OTHER).alias("text"),
    )
    whole = lambda m: m
    always = lambda m: F.lit(True)
    secret = lambda m: F.regexp_extract(m, ASSIGN, 2)
    long_enough = lambda m: F.char_length(secret(m)) >= ASSIGN_LENGTH
    # The characters of access keys and hex runs are those of the wider shape, so they lie inside one match of it.
    mixed = lambda m: (
        m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]") & ~m.rlike(ACCESS) & ~m.rlike(HEX)
    )
    t = F.col("text")
    return rows.select(
        "row", "doc_id", "owner", "repository",
        _found(t, ASSIGN, 0, secret, long_enough).alias("assign"),
        F.concat(_found(t, ACCESS, 1, whole, always), _found(t, HEX, 2, whole, always)).alias("runs"),
        _found(t, OWNED, 3, whole, mixed).alias("wider"),
    )


def outside_assignments(found: DataFrame) -> DataFrame:
    """row and its wider findings that overlap no assignment, for rows that have both.

    Neighbours in order of starts settle it: the farthest end before, and the nearest start behind.
    """
    both = found.filter((F.size("assign") > 0) & (F.size("wider") > 0))
    spans = both.select("row", F.explode(F.concat("assign", "wider")).alias("span"))
    order = Window.partitionBy("row").orderBy("span.start", "span.kind")
    taken = F.col("span.kind") == 0
    farthest = F.max(F.when(taken, F.col("span.end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    nearest = F.min(F.when(taken, F.col("span.start"))).over(
        Window.partitionBy("row").orderBy(F.col("span.start").desc(), F.col("span.kind").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    clear = F.coalesce(farthest <= F.col("span.start"), F.lit(True)) & F.coalesce(nearest >= F.col("span.end"), F.lit(True))
    judged = spans.select("row", "span", clear.alias("clear")).filter("span.kind = 3")
    return judged.groupBy("row").agg(F.collect_list(F.when(F.col("clear"), F.col("span"))).alias("outside"))


def ownership(found: DataFrame) -> DataFrame:
    """Distinct owners and repositories of every value in the corpus."""
    values = F.array_distinct(F.transform("spans", lambda s: s["value"]))
    return (
        found.select("owner", "repository", F.explode(values).alias("value"))
        .distinct()
        .groupBy("value", "owner").agg(F.count("*").alias("repositories"))
        .groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    )


def scan(
    store: TableStore, df: DataFrame, doc_id: str, text: str, owner: str, repository: Column,
    max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """Every row: doc_id, and its findings in order of start and kind, each with owners and repositories of its value
    and whether it is copied; wider findings only if they are not."""
    found = store.write("secret_candidates", candidates(df, doc_id, text, owner, repository))
    cleared = outside_assignments(found)
    found = found.join(cleared, "row", "left").select(
        "row", "doc_id", "owner", "repository", F.concat("assign", "runs", F.coalesce("outside", "wider")).alias("spans")
    )
    found = store.write("secret_findings", found)
    copied = (F.col("owners") > max_owners) | (F.col("repositories") > max_repositories)
    counts = ownership(found).select("value", "owners", "repositories", copied.alias("copied"))
    each = found.select("row", F.explode("spans").alias("span")).join(counts, F.col("span.value") == F.col("value"))
    live = each.filter((F.col("span.kind") < 3) | ~F.col("copied"))
    judged = live.groupBy("row").agg(F.array_sort(F.collect_list(
        F.struct("span.start", "span.kind", "span.end", "owners", "repositories", "copied")
    )).alias("findings"))
    return found.join(judged, "row", "left").select(
        "doc_id", F.coalesce("findings", F.array().cast(f"array<{_JUDGED}>")).alias("findings")
    )


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def op5_owner_frequency(store: TableStore, documents: DataFrame) -> DataFrame:
    """A document's owner is its source; the repository is the part of the source in one language."""
    found = scan(store, documents, "doc_id", "text", "source", F.struct("source", "lang"))
    of = lambda rule: F.filter("findings", rule)
    count = lambda rule: F.size(of(rule)).cast("bigint")
    base = lambda s: s["kind"] < 3
    is_kind = lambda k: lambda s: s["kind"] == k
    spread = F.transform("findings", lambda s: F.concat_ws(":", s["owners"].cast("string"), s["repositories"].cast("string")))
    return found.select(
        "doc_id", *(count(is_kind(k)).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])),
        F.sha2(written(of(base)), 256).alias("base_sha256"), written(F.col("findings")).alias("spans"),
        count(is_kind(3)).alias("n_owned"), count(lambda s: base(s) & s["copied"]).alias("n_copied"),
        count(lambda s: base(s) & ~s["copied"]).alias("n_live"), F.array_join(spread, ",").alias("owners_repositories"),
    )
