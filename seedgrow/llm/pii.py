"""Personal data by weak supervision.

Candidate spans come from strict patterns (the base: e-mail addresses, IPv4
addresses, card numbers, phone numbers) and from loose ones (e-mail addresses
written out with "at" and "dot", national phone numbers, cards of 15 digits,
IPv6 whole or compressed). Three labelers vote on every candidate or abstain:
the strict pattern (which never votes against), a gazetteer
(top-level domains, issuer digits, plausible number ranges; it abstains on
phone numbers of bare groups of digits) and the words before it (the 40 code
points before a span; words such as "order" or "version" just before it speak
against it). Expectation-maximisation over the vote patterns estimates how
reliable each labeler is; its posteriors are the soft labels of a final naive
Bayes classifier over the votes (by reliability) and the span's shape (by its
share in each class of loose candidates, shrunk where these are few). Base spans always stay;
a loose candidate is added when a labeler votes for it, the classifier favours
it and it overlaps no base span.

Everything that touches a row is a JVM expression. Positions come from one
split and one extract of the same pattern: pieces and matches alternate, so
the running sum of their lengths gives every start. The patterns are written
with possessive quantifiers and start only where a run starts, which makes
them linear on long runs (and free of deep recursion) without changing what
they match.

Scale: one pass over the table counts the (kind, votes, shape) patterns, a
table bounded by the product of their few values (below 9,000 rows) whatever
the input; EM and the classifier run on those counts. A second pass scores.
Nothing is shuffled but those counts, and no row meets another.

Edge cases: null text is empty and has no spans; repeated rows get equal
results; an empty table trains nothing and returns no rows; ids are carried
along and never used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedgrow.llm.common import read_table, text_or_empty

KINDS = ["email", "ip", "card", "phone"]

# The base patterns. The comment gives the plain form.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must contain for the base pattern to have a valid match.
_GUARD = {
    "email": r"@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){15}",
    "phone": r"\+[0-9]",
}
# The loose patterns.
_HEX = "[0-9A-Fa-f]{1,4}"
_AT = r"(?:\x20?[(\[{](?i:at)[)\]}]\x20?|\x20(?i:at)\x20)"
_DOT = r"(?:\x20?[(\[{](?i:dot)[)\]}]\x20?|\x20(?i:dot)\x20)"
LOOSE = {
    # Written out: with brackets around "at", or with a "dot" in words.
    "email": rf"(?<!{_LOCAL}){_LOCAL}++(?:{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+"
    r"|\x20?[(\[{](?i:at)[)\]}]\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)",
    # IPv6, whole or with one "::".
    "ip": rf"(?<![0-9A-Za-z:.])(?:{_HEX}(?::{_HEX}){{7}}|(?=[0-9A-Fa-f]*+:)(?:{_HEX}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?))"
    r"(?![0-9A-Za-z:])",
    # Four groups of four digits; fifteen digits in the grouping 4-6-5.
    "card": r"(?<![0-9-])(?:[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([\x20-]?)[0-9]{6}\2[0-9]{5})(?![0-9-])",
    # Three, three and four digits; or a leading zero and further groups.
    "phone": r"(?<![0-9+().-])(?<![0-9]\x20)(?:(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}"
    r"|(?:\(0[1-9][0-9]{0,3}\)|0[1-9][0-9]{0,3})(?:[\x20/.-]{1,2}[0-9]{2,8}){1,5})(?![\x20.-]?[0-9])",
}
_LOOSE_GUARD = {"email": rf"[(\[{{](?i:at)[)\]}}]|{_AT}[A-Za-z0-9-]++{_DOT}", "ip": LOOSE["ip"], "card": LOOSE["card"], "phone": LOOSE["phone"]}
# Four digits close together: in every address, card and national number.
_DIGITS = r"[0-9](?:[\x20().-]{0,3}[0-9]){3}"


def _needs(text: Column, digits: Column) -> dict[str, Column]:
    """Cheap necessary conditions, so that most texts meet one pattern only."""
    return {
        "b_email": text.contains("@"), "b_ip": digits, "b_card": digits, "b_phone": text.contains("+"),
        "l_email": text.rlike(r"(?i)\x20at\x20|[(\[{]at[)\]}]"),
        "l_ip": text.contains(":"), "l_card": digits, "l_phone": digits,
    }

# Gazetteer of each kind, as a pattern over the span; a span that
# the second pattern fits says nothing by its range alone.
_GAZETTEER = {
    "email": r"(?i)(?:\.|dot[)\]}]?\x20?)(?:com|org|net|edu|gov|mil|int|info|biz|io|ai|co|us|uk|de|fr|es|it|nl|eu|ch|at|"
    r"be|pl|se|no|fi|dk|pt|ie|ca|au|jp|cn|in|br|mx|ru)$",
    "ip": r"^0*(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\.|^(?i:[23][0-9a-f]{3}|fe[89ab][0-9a-f]|f[cd][0-9a-f]{2}):",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9]))",
    "phone": r"^(?:\+[1-9]|\(?[2-9][0-9]{2}|\(?0[1-9])",
}
_OPEN = {
    # English words beside "at" and "dot" in words.
    "email": r"(?i)\x20at\x20(?:the|an?|this|that|every|each|one|my|our|your|his|her|its)\x20dot\x20"
    r"|\x20dot\x20(?:in|at|us|it|no|be|de|es|se|io)$",
    "ip": None, "card": None,
    # Groups of digits with only blanks or one mark between them.
    "phone": r"^\(?(?:0[1-9]|[0-9]{3}\x20[0-9]{3}\x20[0-9]{4}$)",
}
# Words before a span that speak for its kind, or against any.
_CONTEXT = {
    "email": r"(?:e-?mail|contact|write|mailto|reach|send|address|\bmsg\b|message)",
    "ip": r"(?:\bip(?:v[46])?\b|host|server|address|login|client|\bping\b|gateway|node)",
    "card": r"(?:card|visa|mastercard|amex|credit|debit|payment)",
    "phone": r"(?:phone|\btel\b|telefon|\bcall|mobile|\bcell|\bfax|whatsapp|contact|\bdial|anruf)",
}
_AGAINST = r"\b(?:version|release|isbn|issn|order|invoice|serial|part no|sha|hash|token|ticket|section|doi|"
_AGAINST += r"reference|\bref|account|model|batch|article|item|page|chapter|date|since|until)"
_AGAINST += r"(?:\W{1,3}(?:no|nr|num|number|id|code|is))?\W{0,3}$"
_CONTEXT_CHARS = 40
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

# EM settings.
EM_ROUNDS = 25
SMOOTHING = 1.0
# Fixed value: how many spans of a class a shape's share in both weighs.
SHRINK = 50.0


def _luhn(digits: Column) -> Column:
    rev = F.split(F.reverse(digits), "")
    value = F.transform(
        rev,
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")
        ),
    )
    return F.aggregate(F.filter(value, lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _possible(kind: str, m: Column) -> Column:
    """Whether a loose match can be of its kind at all."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        groups = F.size(F.filter(F.split(m, ":"), lambda g: g != ""))
        return m.rlike("[0-9]") & F.when(m.contains("::"), groups.between(2, 7)).otherwise(groups == 8)
    if kind == "card":
        return _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 12) & ~m.rlike(r"^(?:0[1-9]|[12][0-9]|3[01])[./-](?:0[1-9]|1[0-2])[./-][0-9]{4}")
    return F.lit(True)


_SPAN = "array<struct<s:int,e:int,m:string>>"


def _found(text: Column, pattern: str, guard: Column) -> Column:
    """All matches with their code point positions, in order."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    pairs = F.arrays_zip(gaps.alias("g"), matches.alias("m"))
    start = F.struct(F.lit(0).alias("p"), F.array().cast(_SPAN).alias("a"))

    def step(acc, x):
        s = acc["p"] + x["g"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("p"), F.concat(acc["a"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("a"))

    whole = F.aggregate(F.filter(pairs, lambda x: x["m"].isNotNull()), start, step)["a"]
    return F.when(guard, whole).otherwise(F.array().cast(_SPAN))


def _char_class(c: Column) -> Column:
    return (
        F.when(c == "", F.lit("edge")).when(c.rlike(r"^[\x20\x09-\x0D]"), F.lit("space"))
        .when(c.rlike("^[0-9]"), F.lit("digit")).when(c.rlike(r"^[\p{L}_]"), F.lit("letter")).otherwise(F.lit("mark"))
    )


def _range_vote(kind: str, m: Column) -> Column:
    vote = F.when(m.rlike(_GAZETTEER[kind]), F.lit(1)).otherwise(F.lit(0))
    if _OPEN[kind] is None:
        return vote
    return F.when(m.rlike(_OPEN[kind]) & (vote == 1), F.lit(-1)).otherwise(vote)


def _describe(kind: str, strict: bool, text: Column, x: Column) -> Column:
    """Votes (1 for, 0 against, -1 abstains) and shape of a candidate."""
    before = F.lower(F.substring(text, F.greatest(x["s"] - (_CONTEXT_CHARS - 1), F.lit(1)),
                                 F.least(x["s"], F.lit(_CONTEXT_CHARS))))
    left = F.when(x["s"] > 0, F.substring(text, x["s"], F.lit(1))).otherwise(F.lit(""))
    right = F.substring(text, x["e"] + 1, F.lit(1))
    context = F.when(before.rlike(_AGAINST), F.lit(0)).when(before.rlike(_CONTEXT[kind]), F.lit(1)).otherwise(F.lit(-1))
    return F.struct(
        F.lit(KINDS.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e"),
        F.lit(1 if strict else -1).alias("v1"),
        _range_vote(kind, x["m"]).alias("v2"),
        context.alias("v3"),
        _char_class(left).alias("f1"), _char_class(right).alias("f2"),
        F.least(F.floor(F.length(x["m"]) / 8), F.lit(4)).cast("int").alias("f3"),
    )


def _check(kind: str, strict: bool):
    return lambda x: (_valid if strict else _possible)(kind, x["m"])


def _describer(kind: str, strict: bool, text: Column):
    return lambda x: _describe(kind, strict, text, x)


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``__sg_base`` and ``__sg_loose``, the described spans."""
    d = docs.withColumn("__sg_text", text_or_empty())
    t = F.col("__sg_text")
    d = d.withColumn("__sg_digits", t.rlike(_DIGITS))
    needs = _needs(t, F.col("__sg_digits"))
    for k in KINDS:
        d = d.withColumns({
            f"__sg_b_{k}": _found(t, BASE[k], needs[f"b_{k}"] & t.rlike(_GUARD[k])),
            f"__sg_l_{k}": _found(t, LOOSE[k], needs[f"l_{k}"] & t.rlike(_LOOSE_GUARD[k])),
        })

    def every(prefix, strict):
        parts = []
        for k in KINDS:
            c = F.filter(F.col(f"{prefix}{k}"), _check(k, strict))
            parts.append(F.transform(c, _describer(k, strict, t)))
        return F.concat(*parts)

    d = d.withColumns({"__sg_base": every("__sg_b_", True), "__sg_loose": every("__sg_l_", False)})
    apart = F.filter(
        "__sg_loose",
        lambda x: ~F.exists("__sg_base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])),
    )
    return d.withColumn("__sg_loose", apart).drop("__sg_text", "__sg_digits", *[f"__sg_{p}_{k}" for k in KINDS for p in "bl"])


def _em(counts: list[tuple]) -> dict[tuple, float]:
    """Posterior of each (kind, votes)."""
    return _estimate(counts)[0]


def _estimate(counts: list[tuple]) -> tuple[dict[tuple, float], list[dict[int, float]]]:
    """Posterior of each (kind, votes), and each labeler's chance to vote for
    a span by its class, by expectation-maximisation.

    ``counts``: (kind, (v1, v2, v3), n). Abstentions carry no evidence.
    """
    labelers = range(3)
    prior = {k: 0.5 for k in range(len(KINDS))}
    # hit[j][y]: P(labeler j votes 1 | class y)
    hit = [{1: 0.8, 0: 0.2} for _ in labelers]
    post: dict[tuple, float] = {}
    for _ in range(EM_ROUNDS):
        for k, v, _n in counts:
            odds = math.log(prior[k] / (1 - prior[k]))
            for j in labelers:
                if v[j] >= 0:
                    p, q = (hit[j][1], hit[j][0]) if v[j] == 1 else (1 - hit[j][1], 1 - hit[j][0])
                    odds += math.log(p / q)
            post[(k, v)] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for k in prior:
            n = sum(c for kk, _, c in counts if kk == k)
            prior[k] = (sum(c * post[(kk, v)] for kk, v, c in counts if kk == k) + SMOOTHING) / (n + 2 * SMOOTHING)
        for j in labelers:
            for y in (1, 0):
                w = [(c * (post[(k, v)] if y else 1 - post[(k, v)]), v[j]) for k, v, c in counts if v[j] >= 0]
                good = 4 if y else 1
                hit[j][y] = (sum(x for x, vote in w if vote == 1) + good * SMOOTHING) / (sum(x for x, _ in w) + 5 * SMOOTHING)
    return post, hit


def train(docs: DataFrame) -> dict[str, float]:
    """Log-odds of the span classifier by ``kind:feature=value``."""
    c = candidates(docs.select("text"))
    c = c.select(F.explode(F.concat("__sg_base", "__sg_loose")).alias("x"))
    names = ["k", "v1", "v2", "v3", "f1", "f2", "f3"]
    rows = c.groupBy(*[F.col(f"x.{n}").alias(n) for n in names]).agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sorted(tuple(r) for r in rows)
    by_votes: dict[tuple, int] = {}
    for k, v1, v2, v3, *_shape, n in rows:
        by_votes[(k, (v1, v2, v3))] = by_votes.get((k, (v1, v2, v3)), 0) + n
    post, hit = _estimate([(k, v, n) for (k, v), n in sorted(by_votes.items())])
    # Votes count by their labeler's reliability, over all kinds. The strict
    # pattern never votes on what the classifier decides.
    odds: dict[str, float] = {}
    for j, h in enumerate(hit[1:], 2):
        for k in range(len(KINDS)):
            odds[f"{k}:v{j}=1"] = math.log(h[1] / h[0])
            odds[f"{k}:v{j}=0"] = math.log((1 - h[1]) / (1 - h[0]))
    # The shape counts by its share in each class of the loose candidates,
    # which alone are decided on (base spans have other shapes), drawn towards
    # its share in both: values seen too seldom say little.
    shape: dict[str, list[float]] = {}
    total: dict[int, list[float]] = {}
    for k, v1, v2, v3, f1, f2, f3, n in rows:
        if v1 >= 0:
            continue
        p = post[(k, (v1, v2, v3))]
        for w in (total.setdefault(k, [0.0, 0.0]), *(shape.setdefault(f"{k}:{f}={v}", [0.0, 0.0])
                                                      for f, v in (("f1", f1), ("f2", f2), ("f3", f3)))):
            w[0] += n * (1 - p)
            w[1] += n * p
    # No prior: base spans are mostly personal data, which says nothing of
    # how often loose candidates are. The evidence alone decides.
    for key, w in shape.items():
        t = total[int(key.split(":")[0])]
        share = sum(w) / sum(t)
        odds[key] = math.log((w[1] + SHRINK * share) / (t[1] + SHRINK)) - math.log((w[0] + SHRINK * share) / (t[0] + SHRINK))
    return odds


def detect(docs: DataFrame, model: dict[str, float] | None = None) -> DataFrame:
    """``docs`` plus ``base_spans`` and ``added_spans``: arrays of (k, s, e)
    in order of kind and start, positions in code points, end exclusive."""
    if model is None:
        model = train(docs)
    d = candidates(docs)
    odds = F.create_map(*[F.lit(x) for kv in (sorted(model.items()) or [("", 0.0)]) for x in kv])

    def score(x):
        k = x["k"].cast("string")
        total = F.lit(0.0)
        for f in ("v2", "v3", "f1", "f2", "f3"):
            total = total + F.coalesce(odds[F.concat(k, F.lit(f":{f}="), x[f].cast("string"))], F.lit(0.0))
        return total

    def chosen(x):
        return ((x["v2"] == 1) | (x["v3"] == 1)) & (score(x) > 0)

    tidy = lambda a: F.transform(a, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    return d.withColumns(
        {"base_spans": tidy(F.col("__sg_base")), "added_spans": tidy(F.filter("__sg_loose", chosen))}
    ).drop("__sg_base", "__sg_loose")


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))),
        ",",
    )


def redact(docs: DataFrame, model: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets;
    overlapping spans are replaced together by the first one's kind."""
    d = detect(docs, model)
    by_start = F.sort_array(
        F.transform(F.concat("base_spans", "added_spans"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))
    )
    d = d.withColumn("__sg_spans", by_start)
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    t = F.col("text")
    start = F.struct(F.lit(0).alias("p"), F.lit("").alias("o"))

    def step(a, x):
        new = F.struct(
            x["e"].alias("p"),
            F.concat(a["o"], F.substring(t, a["p"] + 1, x["s"] - a["p"]), F.get(names, x["k"])).alias("o"),
        )
        joined = F.struct(F.greatest(a["p"], x["e"]).alias("p"), a["o"].alias("o"))
        return F.when(x["s"] >= a["p"], new).otherwise(joined)

    done = F.aggregate(
        "__sg_spans", start, step, lambda a: F.concat(a["o"], F.substring(t, a["p"] + 1, F.length(t)))
    )
    out = F.when(F.size("__sg_spans") > 0, done).otherwise(t)
    return d.withColumn("text", out).drop("__sg_spans", "base_spans", "added_spans")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    d = detect(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base_spans", lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    every = F.sort_array(F.concat("base_spans", "added_spans"))
    return d.select(
        "doc_id", *[n(k) for k in KINDS],
        F.sha2(_written(F.col("base_spans")), 256).alias("base_sha256"),
        _written(every).alias("spans"),
        F.size("added_spans").cast("long").alias("n_added"),
    )
