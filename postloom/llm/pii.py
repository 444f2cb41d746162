"""Personal data by weak supervision, in DataFrame functions alone.

Strict patterns find the base spans, which always stay. Looser patterns find further candidates, of the same kinds and of one
more, secrets (keys and tokens); what overlaps a base span is none. Labelers vote on every candidate, for, against or not at
all: the strict pattern, gazetteers (top-level domains, issuer and calling prefixes, reserved networks, forms of keys), the
words just before, the characters on both sides, and checks of the digits. Expectation-maximisation over the counts of vote
patterns estimates each labeler's reliability for each kind, and its posteriors train a logistic span classifier on the
votes, the kind and the span's shape, which is compiled into a column and decides the loose candidates. All that leaves
Spark is the table of vote patterns, which is bounded by the labelers. Only shares of counts enter the fits, so that a
corpus of any size with the same shares gives the same classifier, but for the pseudo-counts.

Offsets are code points. They come from the lengths of the pieces between matches, as the text is split by its matches.

Defined results: a null text is empty and has no span; repeated rows and null ids are judged one by one; other columns pass
through the pipeline stage untouched. Of loose spans that overlap each other, that of the first kind is added.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import cut, table

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
#: The contracts' patterns, with possessive repeats and starts at the first character of a run: the same matches, found in
#: linear time and without deep recursion.
STRICT = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "(?<![0-9])(?<![0-9][\\x20-])[0-9](?:[\\x20-]?[0-9]){11,}+",  # shorter ones fail the check
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: Looser forms: addresses spelled out, hexadecimal addresses, other account numbers and card numbers that fail the checksum,
#: numbers without the country prefix, and long strings of letters and digits.
LOOSE = {
    "email": "(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\\[(](?:at|@)[\\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\\.|[\\[(](?:dot|\\.)[\\])]) ?[A-Za-z0-9-]{2,63}+)+",
    "ip": "(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])",
    "card": "(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|[0-9]{4}(?:[\\x20-]?[0-9]{4}){3})(?![A-Za-z0-9])",
    "phone": "(?<![0-9A-Za-z.+-])\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    "secret": "(?<![A-Za-z0-9_+/.-])(?=[A-Za-z_+/-]{0,255}[0-9])(?=[0-9_+/-]{0,255}[A-Za-z])[A-Za-z0-9_+/-]{20,}+={0,2}",
}
#: A text without these characters cannot have a match, so most texts are not searched.
_NEEDS = {("email", True): "@", ("ip", True): "[0-9]\\.[0-9]", ("card", True): "[0-9](?:[\\x20-]?[0-9]){11}", ("phone", True): "\\+[0-9]", ("email", False): "(?i)[\\[(](?:at|@)[\\])]", ("ip", False): "[0-9A-Fa-f]:[0-9A-Fa-f]", ("card", False): "[A-Z0-9]{2}[0-9]{2}[\\x20-]?[A-Z0-9]{4}", ("phone", False): "[0-9]{3}\\)?[ .-][0-9]{3}", ("secret", False): "[A-Za-z0-9_+/-]{20}"}
#: Fixed values of the gazetteers.
_DOMAINS = "com|org|net|edu|gov|mil|int|info|io|dev|app|biz|co|uk|de|fr|es|it|nl|ch|at|be|eu|us|ca|au|jp|cn|in|br|ru|se|no|dk|fi|pl|pt|cz|mx|ar"
_CALLING = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-6][0-9]|3[578][0-9]|42[0-3]|5[09][0-9]|6[7-9][0-9]|8[05-8][0-9]|9[679][0-9]"
_CUES = {"email": "mail|contact|write|@", "ip": "ip|addr|host|server|from", "card": "card|visa|credit|debit|account|iban|pay|tarjeta|carte|karte", "phone": "phone|tel|call|mobile|fax|cell|contact", "secret": "token|secret|passw|api.?key|access|bearer|auth|credential|private"}
_OTHER = {"secret": "sha|md5|commit|digest|checksum|etag|hash|uuid|/"}
#: Forms of keys: hexadecimal strings of the usual lengths, and prefixes that issuers give.
_KEYS = "^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|(?:sk|pk|rk)[-_].*|gh[pousr]_.*|AKIA[A-Z0-9]{16}|xox[a-z]-.*|eyJ[A-Za-z0-9_-]+|AIza.*)$"
BEFORE = 24
_PRIOR = {True: 0.9, False: 0.3}
#: What votes for and against multiply and divide the odds by before anything is known of their labelers.
_VOTE = {"v1": (3.0, 3.0), "v2": (6.0, 20.0), "v3": (1.2, 4.0), "v4": (3.0, 30.0)}
RIDGE = 1e-6


def _found(text: Column, pattern: str) -> Column:
    """array<struct<s, m>>: start (code points) and string of each match, in order."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
    empty = F.array().cast("array<struct<s:int,m:string>>")
    return F.aggregate(
        F.filter(pairs, lambda p: p["m"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, p: F.struct((a["at"] + p["g"] + F.length(p["m"])).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + p["g"]).alias("s"), p["m"].alias("m")))).alias("out")),
        lambda a: a["out"],
    )


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    n = F.length(digits)
    at = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, doubled(at(i))).otherwise(at(i)))
    return total % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    """The check that a strict match of the kind has to pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, "\\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(m))).otherwise(False)
    return n.between(9, 15)


def _candidates(text: Column, kind: str, strict: bool) -> Column:
    """array<struct<kind, strict, s, e, m, before, after>> of the matches that pass."""
    pattern = (STRICT if strict else LOOSE)[kind]
    found = _found(text, pattern)
    kept = F.filter(found, lambda x: _holds(kind, x["m"])) if strict else found
    shaped = F.transform(kept, lambda x: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), F.lit(strict).alias("strict"), x["s"].alias("s"), (x["s"] + F.length(x["m"])).alias("e"), x["m"].alias("m"),
        F.lower(F.substring(text, F.greatest(F.lit(1), x["s"] + 1 - BEFORE), F.least(x["s"], F.lit(BEFORE)))).alias("before"), F.substring(text, x["s"] + F.length(x["m"]) + 1, F.lit(1)).alias("after"),
    ))
    return F.when(text.rlike(_NEEDS[kind, strict]), shaped).otherwise(F.array().cast("array<struct<kind:int,strict:boolean,s:int,e:int,m:string,before:string,after:string>>"))


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 for, 2 against, 0 not at all."""
    return F.when(yes, 1).when(no, 2).otherwise(0) if no is not None else F.when(yes, 1).otherwise(0)


def _gazetteer(kind: Column, m: Column) -> Column:
    domain = m.rlike(f"(?i)[.)\\] ](?:{_DOMAINS})$")
    private = m.rlike("^0*(?:0|127|22[4-9]|2[3-5][0-9])\\.")
    return (
        F.when(kind == 0, _vote(domain, ~domain)).when(kind == 1, _vote(~private, private))
        .when(kind == 2, _vote(m.rlike("^(?:[3-6]|2[2-7]|[A-Z]{2})"), m.rlike("^[01]"))).when(kind == 4, _vote(m.rlike(_KEYS))).otherwise(_vote(m.rlike(f"^\\+(?:{_CALLING})"), m.rlike("^\\+0|^\\(?[01]")))
    )


def _context(kind: Column, before: Column) -> Column:
    out = F.lit(0)
    for k, name in enumerate(KINDS):
        out = F.when(kind == k, _vote(before.rlike(_CUES[name]), before.rlike(_OTHER.get(name, "version|order|isbn|part no|serial|sku")))).otherwise(out)
    return out


def _check(kind: Column, m: Column) -> Column:
    """Cards by the checksum; secrets by their digits: long names have few."""
    digits = F.length(_digits(m))
    card = _vote(m.rlike("^[0-9]") & luhn(_digits(m)), m.rlike("^[0-9]"))
    return F.when((kind == 2) & (digits > 0), card).when(kind == 4, F.when(digits * 16 < F.length(m), 2).otherwise(0)).otherwise(0)


def voted(x: Column) -> Column:
    """A candidate with its votes and its shape."""
    joined = F.substring(x["before"], -1, 1).rlike("[a-z0-9_]") | x["after"].rlike("[A-Za-z0-9_]")
    return F.struct(
        x["kind"].alias("kind"), x["strict"].alias("strict"), x["s"].alias("s"), x["e"].alias("e"),
        _vote(x["strict"]).alias("v0"), _gazetteer(x["kind"], x["m"]).alias("v1"), _context(x["kind"], x["before"]).alias("v2"), _vote(~joined, joined).alias("v3"), _check(x["kind"], x["m"]).alias("v4"),
        F.least(F.lit(3), F.floor((x["e"] - x["s"]) / 8)).cast("int").alias("shape"),
    )


VOTES = ("v0", "v1", "v2", "v3", "v4")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and __c, its candidates in order of start and kind, of the given rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumn("__text", text).withColumn("__base", F.concat(*[_candidates(F.col("__text"), k, True) for k in BASE]))
    found = found.withColumn("__more", F.concat(*[_candidates(F.col("__text"), k, False) for k in KINDS]))
    free = F.filter("__more", lambda x: ~F.exists("__base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return found.withColumn("__c", F.transform(F.concat("__base", free), voted)).drop("__text", "__base", "__more")


def reliabilities(table_: list[dict], rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """For counted vote patterns: P(vote | class) by kind and labeler, and each pattern's posterior of being personal data.

    Expectation-maximisation from the priors that strict matches mostly are, others mostly are not, and that votes speak for
    what they say; with pseudo-counts so that no vote is certain.
    """
    n = np.array([r["n"] for r in table_], float)
    kind, votes = np.array([r["kind"] for r in table_]), np.array([[r[v] for v in VOTES] for r in table_])
    start = np.array([_PRIOR[r["strict"]] for r in table_])
    start = start / (1 - start)
    for j, v in enumerate(VOTES[1:], 1):
        start = start * np.where(votes[:, j] == 1, _VOTE[v][0], np.where(votes[:, j] == 2, 1 / _VOTE[v][1], 1.0))
    post, rates = start / (1 + start), None
    for _ in range(rounds):
        rates = np.zeros((len(KINDS), len(VOTES), 2, 3))
        odds = np.zeros((len(KINDS), 2))
        for k in range(len(KINDS)):
            at = kind == k
            for c, weight in ((0, 1 - post), (1, post)):
                odds[k, c] = 1 + (n * weight)[at].sum()
                for j in range(len(VOTES)):
                    prior = np.array([3, 1, 3] if c == 0 else [3, 6, 1], float)
                    counts = np.bincount(votes[at, j], (n * weight)[at], 3) + prior
                    rates[k, j, c] = counts / counts.sum()
        score = np.log(odds[kind, 1] / odds[kind, 0]) + sum(np.log(rates[kind, j, 1, votes[:, j]] / rates[kind, j, 0, votes[:, j]]) for j in range(len(VOTES)))
        post = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return rates, post


def _features(r: dict) -> list[float]:
    return [1.0, *[float(r["kind"] == k) for k in range(len(KINDS))], *[float(r[v] == x) for v in VOTES for x in (1, 2)], *[float(r["shape"] == s) for s in range(4)]]


def classifier(table_: list[dict], post: np.ndarray, rounds: int = 30, ridge: float = RIDGE) -> np.ndarray:
    """Weights of a logistic model of the posteriors on the span's features, by Newton steps on the shares of the patterns."""
    x, n = np.array([_features(r) for r in table_]), np.array([r["n"] for r in table_], float)
    n /= n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (post - p)) - ridge * w
        w = w + np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
    return w


def _accepted(x: Column, w: np.ndarray) -> Column:
    """The classifier as a column: base spans stay, others need odds of more than one. A number that fails the checksum is no card,
    whatever the odds are."""
    w = [float(v) for v in w]
    score = F.lit(w[0])
    for k in range(len(KINDS)):
        score = score + F.when(x["kind"] == k, w[1 + k]).otherwise(0.0)
    at = 1 + len(KINDS)
    for j, v in enumerate(VOTES):
        score = score + F.when(x[v] == 1, w[at + 2 * j]).when(x[v] == 2, w[at + 1 + 2 * j]).otherwise(0.0)
    at += 2 * len(VOTES)
    for s in range(4):
        score = score + F.when(x["shape"] == s, w[at + s]).otherwise(0.0)
    return x["strict"] | (score > 0) & ~((x["kind"] == KINDS.index("card")) & (x["v4"] == 2))


def train(found: DataFrame) -> np.ndarray:
    """The classifier's weights, from the candidates() of all documents."""
    counted = found.select(F.explode("__c").alias("c")).select("c.*").groupBy("kind", "strict", *VOTES, "shape").agg(F.count(F.lit(1)).alias("n"))
    rows = sorted((r.asDict() for r in counted.collect()), key=lambda r: tuple(r[k] for k in ("kind", "strict", *VOTES, "shape")))  # bounded by the labelers
    return classifier(rows, reliabilities(rows)[1]) if rows else np.zeros(5 + len(KINDS) + 2 * len(VOTES))


def spans(found: DataFrame, w: np.ndarray) -> DataFrame:
    """candidates() with __spans instead of __c: array<struct<s, kind, e, strict>>, in order of start and kind."""
    kept = F.filter("__c", lambda x: _accepted(x, w))
    # loose spans of different kinds may overlap: the first kind stays
    clash = lambda x, y: ~y["strict"] & (y["kind"] < x["kind"]) & (y["s"] < x["e"]) & (x["s"] < y["e"])
    out = found.withColumn("__kept", kept).withColumn("__kept", F.filter("__kept", lambda x: x["strict"] | ~F.exists("__kept", lambda y: clash(x, y))))
    slim = F.transform("__kept", lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"), x["strict"].alias("strict")))
    return out.withColumn("__spans", F.sort_array(slim)).drop("__c", "__kept")


def _line(spans_: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of base spans by kind, their digest, the line of all spans of these kinds, that of secrets, and how many all are."""
    found = cut(candidates(docs.select("doc_id", "text")).drop("text"))
    found = spans(found, train(found))
    base = F.filter("__spans", lambda x: x["strict"])
    count = lambda k: F.size(F.filter("__base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.withColumn("__base", base).select("doc_id", *[count(k) for k in range(4)], F.sha2(_line(F.col("__base")), 256).alias("base_sha256"), _line(F.filter("__spans", lambda x: x["kind"] < len(BASE))).alias("spans"), _line(F.filter("__spans", lambda x: x["kind"] >= len(BASE))).alias("secrets"), F.size("__spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of its texts replaced by its kind in angle brackets, and n_chars made anew."""
    found = candidates(docs.select(F.struct(*docs.columns).alias("__row"), "text"))  # the columns' names stay among themselves
    found = spans(found, train(found.select("__c")))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    # spans of different kinds may overlap: the later ones give way to what is left of them
    done = F.aggregate(
        "__spans",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, x: F.when(x["e"] <= a["at"], a).otherwise(F.struct(x["e"].alias("at"), F.concat(a["out"], F.array(
            F.substring("text", a["at"] + 1, F.greatest(F.lit(0), x["s"] - a["at"])), F.get(names, x["kind"]))).alias("out"))),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring("text", a["at"] + 1, F.length("text"))),
    )
    out = found.withColumn("text", F.when(F.size("__spans") > 0, done).otherwise(F.col("text")))
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[made.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


QUERIES = {"op5_pii": op5_pii}
ORACLE_SQL: dict[str, str] = {}
