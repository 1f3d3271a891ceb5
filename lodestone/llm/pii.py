"""Personal data in whole texts, by SQL functions alone.

Regular expressions propose spans, checksums (Luhn for cards, mod 97 for account numbers) and ranges
confirm them, and words nearby move the score. Kinds, in their order where starts are equal:

``email ip card phone``  the base kinds: leftmost non-overlapping matches of a fixed grammar, kept whenever
                         confirmed, whatever their score
``iban``                 country, two digits, up to 30 more letters or digits; mod 97 must be 1
``ssn``                  three, two and four digits with hyphens; kept only near a word that names it
``local_phone``          ten digits without a plus sign; kept only near a word that names it
``secret``               keys of the forms that large providers publish, signed web tokens, and what is assigned to a
                         name such as token, secret, password or api key, of 16 characters and more

Added spans that overlap a base span go. Offsets are code points, ends exclusive.

Nothing here loops over a text more than a fixed number of times: each pattern can only start where a run
of its characters starts, and dots or separators that join a run are first replaced, length for length, by
a control character, so that runs are plain character classes without nested repetition. A null or empty
text has no spans. Rows are kept as they are, repeated ones included; other columns pass through, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain

#: Stands for a joining dot or separator while matching; texts that hold it get FREE in its place first.
JOIN, FREE = "\x01", "\x02"
#: Code points on either side of a span in which context words count.
CONTEXT = 48
#: A span of an added kind needs this score.
LEAST = 0.5


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    #: Words that raise the score by BOOST when they stand near.
    context: str
    base: bool = True


BOOST = 0.3
#: Names that a secret is assigned to, as a bounded look behind; and forms of keys by their published prefixes.
_NAMED = r"""(?<=(?i:token|secret|password|passwd|pwd|api_key|api-key|apikey|access_key|access-key|auth_key|client_secret)["']? {0,2}[:=] {0,2}["']?)"""
_ISSUED = r"AKIA[0-9A-Z]{16}(?![0-9A-Z])|gh[pousr]_[A-Za-z0-9]{36,255}|sk-[A-Za-z0-9_-]{20,255}|xox[abprs]-[A-Za-z0-9-]{10,255}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"
#: Texts without a match of this have no secret.
_MAYBE_SECRET = r"""[:=] {0,2}["']?[A-Za-z0-9+/_.-]{16}|AKIA|gh[pousr]_|sk-|xox[abprs]-|AIza|eyJ"""
KINDS = (
    Kind("email", rf"(?:(?<![A-Za-z0-9._%+{JOIN}-])|\G)[A-Za-z0-9._%+{JOIN}-]++@[A-Za-z0-9-]++{JOIN}[A-Za-z0-9{JOIN}-]*+", 0.7, r"e-?mail|mail|contact|courriel|correo|kontakt"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"\bip\b|address|host|server|adresse|direcci"),
    Kind("card", rf"(?<![0-9{JOIN}])(?:[0-9]{JOIN}?){{12,19}}(?![0-9{JOIN}])", 0.7, r"card|visa|credit|debit|carte|karte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, r"phone|tel|call|mobile|fax|anruf|appel|llam"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", 0.7, r"iban|account|konto|compte|cuenta", base=False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.3, r"\bssn\b|social security|tax id", base=False),
    Kind("local_phone", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])", 0.3, r"phone|tel|call|mobile|fax|anruf|appel|llam", base=False),
    Kind("secret", rf"(?<![A-Za-z0-9+/_.-])(?:{_NAMED}[A-Za-z0-9+/_.-]{{16,}}+={{0,2}}|{_ISSUED})", 0.7, r"key|token|secret|passw|credential", base=False),
)
ORDER = {k.name: i for i, k in enumerate(KINDS)}


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _running(lens: Column) -> Column:
    """Sums of what stands before each element, in blocks of the square root: n ** 1.5 steps."""

    def with_lens(v: Column) -> Column:
        n = F.size(v)
        size = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
        return _let(size, lambda b: _let(blocks(v, n, b), lambda before: sums(v, n, b, before)))

    def sums(v: Column, n: Column, b: Column, before: Column) -> Column:
        def up_to(i: Column) -> Column:
            block = F.floor(i / b).cast("int")
            return F.get(before, block) + total(F.slice(v, block * b + 1, i % b))

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), up_to)).otherwise(F.array().cast("array<int>"))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def blocks(v: Column, n: Column, b: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), b), lambda k: total(F.slice(v, k * b + 1, b)))
        return _let(sums, lambda s: F.transform(F.sequence(F.lit(0), b), lambda k: total(F.slice(s, F.lit(1), k))))

    return _let(lens, with_lens)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(a: Column, i: Column) -> Column:
        d = F.ascii(digits.substr(i, F.lit(1))) - 48
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return a + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _mod97(account: Column) -> Column:
    def turned(s: Column) -> Column:
        moved = F.concat(s.substr(F.lit(5), F.length(s)), s.substr(F.lit(1), F.lit(4)))

        def add(a: Column, c: Column) -> Column:
            code = F.ascii(c)
            return F.when(code < 58, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

        return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(add(a, c))) == 1

    return _let(F.regexp_replace(account, " ", ""), turned)


def _confirmed(kind: str, found: Column) -> Column:
    if kind == "ip":
        value = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(found, r"\."), lambda p: (F.length(value(p)) <= 3) & (F.coalesce(value(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return _let(_digits(found), lambda d: F.length(d).between(12, 19) & _luhn(d))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    if kind == "iban":
        return _mod97(found)
    return F.lit(True)


SPAN = "struct<start:int,rank:int,kind:string,end:int,score:double>"


def _spans(kind: Kind, text: Column, original: Column) -> Column:
    """Confirmed spans of one kind. text: as the pattern wants it, of the same length as original."""
    pattern = F.lit(kind.pattern)

    def located(found: Column) -> Column:
        """Each match with its start: what lies before it is all gaps and matches up to there, and its own gap."""

        def steps(gaps: Column) -> Column:
            lengths = lambda parts: F.transform(parts, lambda x: F.length(x))
            return F.zip_with(lengths(gaps), lengths(found), lambda g, m: F.coalesce(g, F.lit(0)) + F.coalesce(m, F.lit(0)))

        def placed(gaps: Column, before: Column) -> Column:
            one = lambda i: F.struct((F.get(before, i) + F.length(F.get(gaps, i))).alias("start"), F.get(found, i).alias("m"))
            return F.transform(F.sequence(F.lit(0), F.size(found) - 1), one)

        return _let(F.split(text, kind.pattern, -1), lambda gaps: _let(_running(steps(gaps)), lambda before: placed(gaps, before)))

    def span(s: Column) -> Column:
        end = s["start"] + F.length(s["m"])
        lo = F.greatest(s["start"] - CONTEXT, F.lit(0))
        near = F.lower(F.concat_ws(" ", original.substr(lo + 1, s["start"] - lo), original.substr(end + 1, F.lit(CONTEXT))))
        score = F.least(F.lit(kind.score) + F.when(F.regexp_like(near, F.lit(kind.context)), BOOST).otherwise(0.0), F.lit(1.0))
        return F.struct(s["start"].alias("start"), F.lit(ORDER[kind.name]).alias("rank"), F.lit(kind.name).alias("kind"), end.alias("end"), F.round(score, 3).alias("score"))

    def some(found: Column) -> Column:
        kept = F.transform(F.filter(located(found), lambda s: _confirmed(kind.name, s["m"])), span)
        return F.when(F.size(found) > 0, kept if kind.base else F.filter(kept, lambda s: s["score"] >= LEAST)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return _let(F.regexp_extract_all(text, pattern, F.lit(0)), some)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __pii_base and __pii_all: arrays of spans, by start and kind."""
    original = F.coalesce(F.col(text), F.lit(""))
    free = F.translate(original, JOIN, FREE)
    dotted = F.regexp_replace(free, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", JOIN)
    joined = F.regexp_replace(free, r"(?<=[0-9])[ -](?=[0-9])", JOIN)
    views = {"email": dotted, "card": joined}
    # Cheap tests that rule most texts out before any pattern runs.
    wants = {"email": F.contains(original, F.lit("@")), "phone": F.contains(original, F.lit("+")), "secret": F.regexp_like(original, F.lit(_MAYBE_SECRET))}
    none = F.array().cast(f"array<{SPAN}>")
    digits = F.regexp_like(original, F.lit("[0-9]"))

    def of(kind: Kind) -> Column:
        here = _let(views[kind.name], lambda t: _spans(kind, t, original)) if kind.name in views else _spans(kind, original, original)
        return F.when(wants.get(kind.name, digits), here).otherwise(none)

    base = F.concat(*(of(k) for k in KINDS if k.base))
    added = F.concat(*(of(k) for k in KINDS if not k.base))
    with_base = docs.withColumn("__pii_base", F.array_sort(base)).withColumn("__pii_added", added)
    free_of = F.filter("__pii_added", lambda s: ~F.exists("__pii_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    every = F.when(F.size("__pii_added") > 0, F.array_sort(F.concat(F.col("__pii_base"), free_of))).otherwise(F.col("__pii_base"))
    return with_base.withColumn("__pii_all", every).drop("__pii_added")


def find(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each row: counts of the base kinds, a digest of the base spans, and all spans with scores."""
    found = with_spans(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text")
    count = lambda name: F.size(F.filter("__pii_base", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    counts = [count(k.name) for k in KINDS if k.base]
    secrets = F.size(F.filter("__pii_all", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret")
    digest = F.sha2(_written(F.col("__pii_base")), 256).alias("base_sha256")
    scores = F.array_join(F.transform("__pii_all", lambda s: s["score"].cast("string")), ",").alias("scores")
    return found.select("doc_id", *counts, digest, _written(F.col("__pii_all")).alias("spans"), scores, secrets)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span's characters replaced by its kind in angle brackets; the same columns.

    Overlapping spans count as one, named after the first.
    """
    # All columns as one, beside which the names in use here clash with nothing.
    found = with_spans(docs.select(F.struct(*plain(docs)).alias("doc"), F.col(text).alias("text")), "text")

    def joined(a: Column, s: Column) -> Column:
        """The spans so far and one more, which widens the last one where they overlap."""
        last = F.element_at(a, -1)
        span = lambda start, end, kind: F.array(F.struct(start.alias("start"), end.alias("end"), kind.alias("kind")))
        wider = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), span(last["start"], F.greatest(last["end"], s["end"]), last["kind"]))
        return F.when((F.size(a) > 0) & (last["end"] > s["start"]), wider).otherwise(F.concat(a, span(s["start"], s["end"], s["kind"])))

    merged = F.aggregate("__pii_all", F.array().cast("array<struct<start:int,end:int,kind:string>>"), joined)
    found = found.withColumn("__pii_merged", F.when(F.size("__pii_all") > 0, merged))
    source = F.col("text")
    named = lambda i: F.concat(F.lit("<"), F.upper(F.get("__pii_merged", i)["kind"]), F.lit(">"))
    pieces = F.transform(F.sequence(F.lit(0), F.size("__pii_merged") - 1), lambda i: F.concat(_between(source, i), named(i)))
    tail = source.substr(F.element_at("__pii_merged", -1)["end"] + 1, F.length(source))
    clean = F.when(F.size("__pii_merged") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(source)
    found = found.withColumn("text", clean)
    made = {text: F.col("text")}
    if "n_chars" in docs.columns and text == "text":
        known = F.col("doc").getField("n_chars")
        made["n_chars"] = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), known)
    return found.select(*(made.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))


def _between(source: Column, i: Column) -> Column:
    lo = F.when(i > 0, F.get("__pii_merged", i - 1)["end"]).otherwise(F.lit(0))
    return source.substr(lo + 1, F.get("__pii_merged", i)["start"] - lo)
