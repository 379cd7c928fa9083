r"""Personal data by patterns, and terms that disclose it by what the corpus knows (native DataFrame operations only).

Patterns find e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers: the protected entities. Besides each
entity its mail domain and its kind are judged, so that terms at rare entities have evidence too. For e, an entity or such a
class, and every term t (a run of three letters or more, lower-cased) within `CONTEXT` characters of it, the corpus gives
    disclosure(t, e) = PMI(t, e) / IC(e) = 1 + ln P(e|t) / ln(W / c(e)),   IC = ln(W / c(e))
with W windows of `CONTEXT` characters in all texts and c(e) occurrences of e. P(e|t) is c(t,e) / c(t), 1 at most, smoothed
to independence: n texts that show t at e count n, and c(e) / W counts `SMOOTH`; c(t) are occurrences of t anywhere, c(t,e)
occurrences of e with t near. Copies of a text are one text. A term that reaches `THRESHOLD` for an entity or class, and
that `SUPPORT` different texts show there, is a span wherever it stands, also far from the entity, and is generalised to
a mark. A class at every window discloses nothing. The support is the same whatever the corpus's size: a term seen once
beside an entity seen once is a coincidence in large corpora as in small ones. Terms exactly at either bound are spans.

The context is taken by position: over other matches, and without a word that its edge cuts.

Terms are sought by a semi-join on hash buckets (at most 2 ** `BUCKET_BITS` numbers, hence broadcast) and then exactly by
value. Positions are prefix sums of the lengths between and of matches, inside the row.

Patterns start at the head of a run of their characters and do not backtrack; they match what the plain forms match.
Null text is empty. Repeated rows, null ids and extra columns are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Kind, pattern, and a cheaper pattern that every text with a valid match has.
KINDS = [("email", EMAIL, "@"), ("ip", IP, r"[0-9]\.[0-9]"), ("card", CARD, r"(?:[0-9][\x20-]?){15}[0-9]"), ("phone", PHONE, r"\+[0-9]")]
CONTEXT, THRESHOLD, SUPPORT, SMOOTH, BUCKET_BITS, RUN = 64, 0.95, 3, 1.0, 20, 256


def _none() -> Column:
    return F.array().cast("array<string>")


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        plain = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.coalesce(plain(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))

        def add(total, i):
            v = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
            return total + F.when(v > 9, v - 9).otherwise(v)

        return F.when((n >= 16) & (n <= 19), F.aggregate(places, F.lit(0), add) % 10 == 0).otherwise(False)
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def _matches(docs: DataFrame, text: str, kinds) -> DataFrame:
    """`parts_k` (texts between) and `found_k` (matches) for each kind k."""
    cols = {}
    for kind, pattern, hint in kinds:
        there = F.col(text).contains(hint) if hint == "@" else F.col(text).rlike(hint)
        cols[f"found_{kind}"] = F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(_none())
    docs = docs.withColumns(cols)
    return docs.withColumns({f"parts_{k}": F.when(F.size(f"found_{k}") > 0, F.split(text, p, -1)).otherwise(_none()) for k, p, _ in kinds})


def _terms(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: F.length(w) >= 3)


def occurrences(texts: DataFrame) -> DataFrame:
    """`entity, th, terms` for each protected entity found in `text`; `th` is the text's hash."""
    m = _matches(texts.select("text"), "text", KINDS)

    def each(kind: str) -> Column:
        parts, found = F.col(f"parts_{kind}"), F.col(f"found_{kind}")
        whole = lambda p, f: F.concat(p, F.coalesce(f, F.lit("")))

        def near(s):
            # a match has two characters or more, so the context reaches over `CONTEXT` / 2 others at most
            i, first = s["i"], F.greatest(s["i"] - CONTEXT // 2 - 1, F.lit(0))
            ahead = F.zip_with(F.slice(parts, first + 1, i - first), F.slice(found, first + 1, i - first), whole)
            after = F.zip_with(F.slice(parts, i + 2, F.lit(CONTEXT // 2 + 2)), F.slice(found, i + 2, F.lit(CONTEXT // 2 + 2)), whole)
            # one character more tells whether the edge of the context cuts a word, which is left out
            wide_l, wide_r = F.concat(F.array_join(ahead, ""), F.get(parts, i)), F.array_join(after, "")
            left = F.regexp_replace(F.substring(wide_l, -CONTEXT - 1, CONTEXT + 1), rf"^(?=[\s\S]{{{CONTEXT + 1}}})(?:\p{{L}}+|[\s\S])", "")
            left = F.when(F.length(wide_l) > CONTEXT, left).otherwise(wide_l)
            right = F.when(F.length(wide_r) > CONTEXT, F.regexp_replace(F.substring(wide_r, 1, CONTEXT + 1), r"(?:\p{L}+|[\s\S])\z", "")).otherwise(wide_r)
            key = F.lower(s["x"]) if kind in ("email", "ip") else F.regexp_replace(s["x"], "[^0-9]", "")
            return F.struct(F.concat(F.lit(kind + ":"), key).alias("entity"), F.array_distinct(_terms(F.concat_ws(" ", left, right))).alias("terms"))

        placed = F.transform(found, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        return F.transform(F.filter(placed, lambda s: _valid(kind, s["x"])), near)

    m = m.where(reduce(lambda a, b: a | b, [F.size(f"found_{k}") > 0 for k, _, _ in KINDS]))
    return m.select(F.xxhash64("text").alias("th"), F.explode(F.concat(*[each(k) for k, _, _ in KINDS])).alias("s")).select("th", "s.entity", "s.terms")


def _bucket(c) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(1 << BUCKET_BITS))


def _words_in(texts: DataFrame, terms: DataFrame, *keep: str) -> DataFrame:
    """Occurrences in `text` of words whose bucket some term has: `word` and the columns to keep."""
    some = F.broadcast(terms.select(_bucket("term").alias("bucket")).distinct())  # 2 ** BUCKET_BITS rows at most
    words = texts.select(*keep, F.explode(_terms(F.col("text"))).alias("word"))
    return words.join(some, _bucket("word") == F.col("bucket"), "left_semi")


def _classes(entity: Column) -> list[Column]:
    """The mail domain (null for others) and the kind of an entity."""
    kind = F.substring_index(entity, ":", 1)
    return [F.when(kind == "email", F.concat(F.lit("email:@"), F.substring_index(entity, "@", -1))), kind]


def disclosing(texts: DataFrame, threshold: float = THRESHOLD, smooth: float = SMOOTH, support: int = SUPPORT) -> DataFrame:
    """`term, entity, disclosure` of the terms that disclose an entity or class; `texts` has a non-null `text`."""
    occ = staged(occurrences(texts))
    targets = F.array_compact(F.array("entity", *_classes(F.col("entity"))))
    met = occ.select("th", "terms", F.explode(targets).alias("entity")).select("th", "entity", F.explode("terms").alias("term"))
    pairs = met.groupBy("term", "entity", "th").agg(F.count("*").alias("n"))
    pairs = staged(pairs.groupBy("term", "entity").agg(F.sum("n").alias("cte"), F.count("*").alias("texts")))
    ct = _words_in(texts, pairs).groupBy("word").agg(F.count("*").alias("ct"))
    # the few kinds, which nearly every term meets, are not joined
    ce = occ.select(F.explode(targets).alias("entity")).groupBy("entity").agg(F.count("*").alias("ce"))
    ce = staged(ce)
    kinds = {r["entity"]: r["ce"] for r in ce.where(F.col("entity").isin([k for k, _, _ in KINDS])).collect()}
    common = F.lit(None).cast("long")
    for k, n in kinds.items():
        common = F.when(F.col("entity") == k, F.lit(n)).otherwise(common)
    few = F.col("entity").isin([k for k, _, _ in KINDS])
    pairs = pairs.where(~few).join(ce, "entity").unionByName(pairs.where(few).withColumn("ce", common))
    windows = float(texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) / CONTEXT
    w = F.lit(max(windows, 1.0))
    share = F.least(F.col("cte") / F.col("ct"), F.lit(1.0))
    share = (F.col("texts") * share + smooth * F.col("ce") / w) / (F.col("texts") + smooth)
    score = 1 + F.log(share) / F.log(w / F.col("ce"))
    named = pairs.where((F.col("ce") < w) & (F.col("texts") >= support)).join(ct, F.col("term") == F.col("word")).select("term", "entity", score.alias("disclosure"))
    return staged(named.where(F.col("disclosure") >= threshold))


def spans(docs: DataFrame, threshold: float = THRESHOLD, smooth: float = SMOOTH) -> DataFrame:
    """`docs` with `pii`: array of `kind, start, end` (code points, end exclusive), by kind as listed, terms last."""
    d = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    texts = d.select(F.col("_text").alias("text"))
    terms = disclosing(texts, threshold, smooth).select("term").distinct()
    hits = _words_in(texts.select("text", F.sha2("text", 256).alias("key")), terms, "key").distinct().join(terms, F.col("word") == F.col("term"))
    hits = staged(hits.groupBy("key").agg(F.array_sort(F.collect_set("term")).alias("_terms")))
    # one plan at every size: texts go once through an exchange, however few or many of them have terms
    d = d.withColumn("_key", F.sha2("_text", 256)).join(hits.hint("merge"), F.col("_key") == F.col("key"), "left").drop("key", "_key")
    d = _matches(d, "_text", KINDS)
    rx = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("_terms", "|"), F.lit(r")(?!\p{L})"))
    d = d.withColumn("_rx", rx).withColumns({
        "found_term": F.when(F.col("_rx").isNotNull(), F.expr("regexp_extract_all(_text, _rx, 0)")).otherwise(_none()),
        "parts_term": F.when(F.col("_rx").isNotNull(), F.expr("split(_text, _rx, -1)")).otherwise(_none()),
    })
    names = [k for k, _, _ in KINDS] + ["term"]

    def lengths(k):
        """The length before each match and of it, in turn."""
        both = F.zip_with(F.transform(f"parts_{k}", F.length), F.transform(f"found_{k}", F.length), lambda gap, own: F.array(gap.cast("long"), own.cast("long")))
        return F.flatten(F.slice(both, 1, F.size(f"found_{k}")))

    d = d.withColumn("_sum", F.transform(F.concat(*[lengths(k) for k in names]), lambda x: x.cast("long")))    # sums of whole runs of `RUN` lengths, then within the run: no array is copied element by element
    upto = lambda n: F.sequence(F.lit(0), n)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    d = d.withColumn("_len", F.concat(*[lengths(k) for k in names]))
    runs = F.transform(upto(F.floor(F.size("_len") / RUN).cast("int")), lambda b: total(F.slice("_len", b * RUN + 1, F.lit(RUN))))
    d = d.withColumn("_run", F.when(F.size("_len") > 0, runs))
    before = F.aggregate("_run", F.array(F.lit(0).cast("long")), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))
    d = d.withColumn("_before", F.when(F.size("_run") > 0, before))
    inside = lambda i: total(F.slice("_len", i - i % RUN + 1, i % RUN + 1))
    d = d.withColumn("_sum", F.when((F.size("_len") > 0) & (F.size("_before") > 0), F.transform("_len", lambda _, i: F.get(F.col("_before"), F.floor(i / RUN).cast("int")) + inside(i))).otherwise(F.array().cast("array<bigint>")))

    def placed(k: str, first: Column) -> Column:
        def span(m, i):
            base = F.when(first > 0, F.get(F.col("_sum"), first - 1)).otherwise(0)
            return F.struct(F.lit(k).alias("kind"), (F.get(F.col("_sum"), first + 2 * i) - base).alias("start"), (F.get(F.col("_sum"), first + 2 * i + 1) - base).alias("end"), m.alias("m"))

        got = F.filter(F.transform(f"found_{k}", span), lambda s: _valid(k, s["m"]))
        return F.transform(got, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    first, out = F.lit(0), []
    for k in names:
        out.append(placed(k, first))
        first = first + 2 * F.size(f"found_{k}")
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], F.concat(*out).alias("pii"))


def sanitised(docs: DataFrame, threshold: float = THRESHOLD, smooth: float = SMOOTH) -> DataFrame:
    """`docs` whose text has `[KIND]` in place of every span (overlapping spans become one), and `n_chars` to match."""
    s = spans(docs, threshold, smooth)
    cuts = F.array_sort(F.transform("pii", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def join(done, x):
        last = F.element_at(done, -1)
        over = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] > x["start"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(over))).otherwise(F.concat(done, F.array(x)))

    s = s.withColumn("_cut", F.aggregate(cuts, F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>"), join))
    end = lambda i: F.when(i > 0, F.get(F.col("_cut"), i - 1)["end"]).otherwise(0)
    piece = lambda x, i: F.concat(F.substring(F.col("text"), (end(i) + 1).cast("int"), (x["start"] - end(i)).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]"))
    tail = F.substring(F.col("text"), (F.element_at("_cut", -1)["end"] + 1).cast("int"), F.length("text"))
    text = F.when(F.size("_cut") > 0, F.concat(F.array_join(F.transform("_cut", piece), ""), tail)).otherwise(F.col("text"))
    s = s.withColumn("text", text)
    if "n_chars" in docs.columns:
        s = s.withColumn("n_chars", F.when(F.size("_cut") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return s.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda x: x["kind"] != "term")
    return s.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone", "term")], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("pii")).alias("spans"))
