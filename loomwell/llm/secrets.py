"""Secret scans: candidates by pattern, false positives removed by a random forest.

Everything on the way of the documents is column expressions: a text is split at
its candidates, so that each candidate has the text before and after it at hand,
its features are computed beside it, and the forest is a sum of CASE trees. There
is one scan, no shuffle and no Python.

The forest is grown from labelled findings. There is no table of them, so
``labelled_findings`` makes some by rule; real ones can be given instead, as rows of the same form.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import forest

# All that repeats is possessive, which Java runs as a loop: other groups recurse once a turn and end in a full stack on a long key.
_GAP = r"(?:[ \t\r\n]|\\[nr])*+"  # between the lines of a key; in strings they may be written as signs
_LINE_ENDS = r"(?=[ \t]*+(?:(?![^\r\n])|\\[nr]|-----|[\"']))"
# Lines of Name: value, one at least, then an empty line and key characters.
_HEADERS = rf"(?:[ \t]*+\r?+\n(?:[A-Za-z][A-Za-z0-9\-]{{0,60}}+:[^\n]*+\n(?:[ \t]++[^\s][^\n]*+\n)*+)++[ \t\r]*+\n(?=[ \t]*+[A-Za-z0-9+/=]{{16,}}+{_LINE_ENDS}))?+"
# Runs of key characters that fill a line to its end, or within a line where they are no word.
_BODY = rf"(?:{_GAP}(?:(?=[A-Za-z=]{{0,39}}+[0-9+/]|[A-Za-z=]{{40}})[A-Za-z0-9+/=]{{16,}}+(?![^\s\\\-\"'])|[A-Za-z0-9+/=]{{16,}}+{_LINE_ENDS}))"
_LAST = rf"{_GAP}[A-Za-z0-9+/=]{{1,64}}+(?={_GAP}-----END)"
_END = rf"(?:{_GAP}-----END [A-Z ]{{0,20}}PRIVATE KEY(?: BLOCK)?-----)"
_KEY_WORD = r"(?i:token|secret|passwd|password|passphrase|pwd|credentials?|(?:api|access|private|auth|account)[\-_]?key)"
# Private key blocks with their headers, lines and END line; quoted values after = or :; values without quotes after a key word, in any
# spelling, and = or :; long runs of key characters with a digit. Each goes to its end, however long it is.
# All but the first begin after a sign that is no letter or digit; asking that first spares most places the rest.
CANDIDATE = (
    rf"-----BEGIN [A-Z ]{{0,20}}PRIVATE KEY(?: BLOCK)?-----{_HEADERS}(?:{_BODY}++(?:{_LAST})?+{_END}?+|{_LAST}{_END})"
    r"|(?<![A-Za-z0-9])(?:(?<=[=:] {0,3}[\"'])[^\s\"']{8,}"
    rf"|(?<=[=:>] {{0,3}})(?<={_KEY_WORD}[\"']? {{0,3}}(?:[=:]|:=|=>) {{0,3}})[^\s\"'`,;<>(){{}}\[\]]{{8,}}"
    r"|(?<![A-Za-z0-9+/_.\-])(?=[A-Za-z+/_.\-]*+[0-9])[A-Za-z0-9+/_.\-]{16,}={0,2})"
)
BEFORE, AFTER = 48, 24

# Words that make up the dictionary for coverage.
DICTIONARY = (
    "about above after again alpha application apply archive article author autumn backup banner basic beta black blue board build button cache calendar "
    "center change channel chapter check class client cloud code color column comment common company config connect contact content control copy country "
    "create current data date default delete demo detail device digital document domain download email empty enable engine entry error event example "
    "export feature field file filter final first folder font footer form format frame front function gallery general global green group guide header "
    "height hello help history home host image import index info input insert install item java json label language large layout left letter level library "
    "light link list load local location login main manager march master media member menu message method mobile model module monday month name network news "
    "number object office online open option order page paper param parent part path photo place plan player point post press price print private product "
    "profile program project public query question random range read record release remote report request result return right round sample school score "
    "screen script search section select server service session setting share shop short sign simple single site size small source south space special "
    "standard start state static status store story string student style subject submit summer sunday support system table target team template test text "
    "theme time title today tool total track type under unit update upload user value version video view water website week white width window winter word "
    "work world write year yellow your"
).split()
KEY_WORDS = r"(?i)(token|secret|passw|passphrase|pwd|api.?key|access.?key|account.?key|auth|bearer|credential|private|signature)"
OTHER_WORDS = r"(?i)((?<![a-z])(example|sample|dummy|placeholder|changeme|commit|sha-?1|sha-?256|md5|checksum|digest|uuid|guid|order|invoice|isbn|version|e?mail|card|phone)(?![a-z])|xxxx|your[_-]|changeme|https?:|www\.)"
TEST_PATH = r"(?i)(^|[/_.\-])(tests?|examples?|docs?|samples?|fixtures?|mocks?)([/_.\-]|$)"
FEATURES = ["length", "transitions", "digits", "capitals", "symbols", "distinct", "hexadecimal", "dictionary", "key_near", "other_near", "assigned", "equals", "quoted", "test_path", "dotted", "key_inside", "vowel_steps", "consonant_runs"]

# The characters that are told apart, all that ASCII can print.
PRINTABLE = "".join(map(chr, range(33, 127)))


def _share(c: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(c, pattern, "")) / F.greatest(F.length(c), F.lit(1))


def features(before: Column, cand: Column, after: Column, path: Column) -> list[Column]:
    """The FEATURES of a candidate as doubles."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(cand, "[^a-zA-Z0-9]", "-"), "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "1")
    words = "(?i)(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")"
    yes = lambda c: c.cast("double")
    return [
        F.length(cand).cast("double"),
        (F.length(F.regexp_replace(shape, r"(.)\1+", "$1")) - 1) / F.greatest(F.length(cand), F.lit(1)),
        _share(cand, "[^0-9]"),
        _share(cand, "[^A-Z]"),
        _share(cand, "[A-Za-z0-9]"),
        F.aggregate(F.array(*[F.lit(c) for c in PRINTABLE]), F.lit(0), lambda n, c: n + F.contains(cand, c).cast("int")) / F.least(F.greatest(F.length(cand), F.lit(1)), F.lit(64)),
        yes(cand.rlike(r"^[0-9a-fA-F]+\z")),
        F.lit(1.0) - _share(cand, words),
        yes(before.rlike(KEY_WORDS)),
        yes(before.rlike(OTHER_WORDS) | cand.rlike(OTHER_WORDS)),
        yes(before.rlike(r"[:=]>?\s*[\"'`]?\s*\z")),
        yes(before.rlike(r"=>?\s*[\"'`]?\s*\z")),
        yes(before.rlike(r"[\"'`]\z") & after.rlike(r"^[\"'`]")),
        yes(F.coalesce(path, F.lit("")).rlike(TEST_PATH)),
        F.length(F.regexp_replace(cand, r"[^./]", "")).cast("double"),
        yes(cand.rlike(r"^(AKIA|ASIA|gh[pousr]_|sk_live_|xox[abp]-|AIza|eyJ|glpat-|npm_|-----BEGIN)")),
        _share(cand, "(?i)[aeiouy][^aeiouy0-9]"),
        _share(cand, "(?i)[bcdfghjklmnpqrstvwxz]{4,}"),
    ]


@dataclass(frozen=True)
class Scanner:
    trees: list
    threshold: float = 0.5


def labelled_findings(n: int = 2400, seed: int = 17) -> list[tuple[str, str, str, str, int]]:
    """(before, candidate, after, path, label) rows made by rule; label 1: a secret."""
    import random

    r = random.Random(seed)
    hexes, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    alnum = b64[:62]
    run = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: run("aeiourstnlm", r.randint(2, 9))
    name = lambda: r.choice(["token", "secret", "api_key", "password", "auth_token", "client_secret", "access_key", "TOKEN", "apiKey", "Password", "api-key", "ACCESS_KEY", "dbPassword", "pwd", "secret-key", "AccountKey"])
    low, digrams = "abcdefghijklmnopqrstuvwxyz", "th he in er an re on at en nd st es ng of te ed or ti hi as to ar le is ve me al ou it ha".split()
    spoken = lambda k: "".join(r.choice(digrams) for _ in range(k))
    pem = lambda n: "-----BEGIN " + r.choice(["", "RSA ", "EC ", "OPENSSH "]) + "PRIVATE KEY-----\n" + "\n".join(run(b64, 64) for _ in range(n)) + r.choice(["", "\n" + run(b64, 20) + "==\n-----END PRIVATE KEY-----"])
    lead = lambda: " ".join(word() for _ in range(r.randint(0, 5)))
    glue = lambda: r.choice([' = "', "=", ": ", ' : "', '="', " = '", '": "', " => ", " := ", " = "])
    path = lambda: r.choice(["src0", "src7", "app/settings.py", "deploy/prod.env", "", "web/index.html"])
    test = lambda: r.choice(["tests/test_api.py", "docs/usage.md", "examples/demo.js"])

    def secret():
        g = glue()
        c = r.choice([
            lambda: run(hexes, r.choice([32, 40, 40, 40, 64])), lambda: run(alnum, r.randint(20, 48)), lambda: run(b64, r.choice([40, 44, 64])) + r.choice(["", "=", "=="]),
            lambda: "AKIA" + run("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: "ghp_" + run(alnum, 36), lambda: "sk_live_" + run(alnum, 24),
            lambda: "eyJ" + run(alnum, 30) + "." + run(alnum, 40) + "." + run(alnum + "_-", 43), lambda: run(alnum + "!@#%^&*", r.randint(10, 20)),
            lambda: run(low, r.randint(14, 28)), lambda: run(alnum[:52], r.randint(14, 40)), lambda: run(low + "0123456789", r.randint(12, 32)), lambda: pem(r.randint(1, 20)),
            lambda: "".join(r.choice(DICTIONARY) for _ in range(r.randint(2, 4))), lambda: r.choice(DICTIONARY) * 3,
        ])()
        if c.isalpha() and g == ": ":  # like prose, see below
            g = "="
        own = c[:3] in ("AKI", "ghp", "sk_", "eyJ", "---") and (c[0] == "-" or r.random() < 0.5)
        return (lead() + " " if own else f"{lead()} {name()}{g}", c, (g[-1] if g[-1] in "\"'" else "") + " " + lead(), path(), 1)

    def other():
        kinds = [
            lambda: (lead() + " ", run("0123456789", r.choice([16, 16, 16, 19, 20])), " " + lead(), path()),
            lambda: (f"{lead()} {word()}.{r.randint(1, 99)}@", f"mail{r.randint(1, 9)}.{word()}.com", " " + lead(), path()),
            lambda: (lead() + " " + r.choice(["id: ", "uuid=", ""]), "-".join(run(hexes, k) for k in (8, 4, 4, 4, 12)), " ", path()),
            lambda: (lead() + r.choice([" commit ", " sha1: ", " sha256: ", ' checksum = "', " md5 "]), run(hexes, r.choice([32, 40, 64])), r.choice(["", '"', " "]) + lead(), path()),
            lambda: (lead() + " ", "-".join([word() + word(), word() + word(), str(r.randint(1, 2030)), word()]), " " + lead(), path()),
            lambda: (lead() + " https://", f"www.{word()}.org/{word()}/{r.randint(1, 2030)}/{word()}_{word()}.html", " ", path()),
            lambda: (lead() + " ", f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}.{r.randint(10, 59)}.{r.randint(10, 59)}", " ", path()),
            lambda: (f"{lead()} {name()}{glue()}", r.choice(["your_token_goes_here", "changeme123", "xxxxxxxxxxxxxxxx1", "example_secret_value", "placeholder-token-0001", "insert-your-key-here"]), r.choice(['"', " "]), path()),
            lambda: (f'{lead()} {name()}{glue()}', run(hexes, 40) if r.random() < 0.3 else "test_" + word() + "_1234567890", '"', test()),
            lambda: (f'{lead()} {r.choice(["title", "class", "href", "label", "color"])}{r.choice([" = ", ": ", "="])}"', "_".join(r.choice(DICTIONARY) for _ in range(r.randint(2, 4))), '" ' + lead(), path()),
            lambda: (lead() + " ", run("0123456789", 3) + "." + run("0123456789", 3) + "." + run("0123456789", 3) + "." + run("0123456789", 5), " " + lead(), path()),
            lambda: (lead() + " ", word() + word() + word() + str(r.randint(1, 999)) + word(), " " + lead(), path()),
            lambda: (f"{lead()} {name()}: ", r.choice([spoken(r.randint(4, 10)), r.choice(DICTIONARY) + r.choice(["ing", "tion", "able", "ment"]), word() + word() + word()]) + r.choice(["", ".", "."]), " " + lead(), path()),
            lambda: (f"{lead()} {name()}: ", spoken(r.randint(4, 7)) + r.choice(["", "ing", "ed", "."]), " " + lead(), path()),
            lambda: (f'{lead()} {r.choice(["title", "name", "note", "caption"])}{r.choice([" = ", ": ", "="])}"', spoken(r.randint(4, 12)), '" ' + lead(), path()),
        ]
        return (*r.choice(kinds)(), 0)

    cut = lambda t: (t[0][-BEFORE:], t[1], t[2][:AFTER], *t[3:])
    return [cut(secret() if r.random() < 0.45 else other()) for _ in range(n)]


def fit(spark: SparkSession, findings: list[tuple] | None = None, *, threshold: float = 0.5) -> Scanner:
    """Grow the forest from (before, candidate, after, path, label) rows, by default ``labelled_findings()``.

    The rows are given by the caller and so of bounded number; their features
    are computed by the same expressions as those of documents.
    """
    import numpy as np

    df = spark.createDataFrame(findings if findings is not None else labelled_findings(), "before string, cand string, after string, path string, label int")
    cols = features(F.col("before"), F.col("cand"), F.col("after"), F.col("path"))
    rows = df.select("label", *[c.alias(n) for n, c in zip(FEATURES, cols)]).collect()
    x = np.array([[float(v) for v in r[1:]] for r in rows])
    y = np.array([r[0] for r in rows], float)
    return Scanner(forest.grow(x, y), threshold)


def rated(text: Column, path: Column, scanner: Scanner) -> Column:
    """array<struct<p, cand, score>> of a text's candidates; p is what stands between a candidate and the one before it."""
    cands = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    both = F.array(F.struct(cands.alias("c"), F.split(text, CANDIDATE, -1).alias("p")))
    placed = F.transform(both, lambda s: F.transform(s["c"], lambda c, i: F.struct(
        c.alias("cand"), s["p"][i].alias("p"), F.substring(s["p"][i], F.greatest(F.length(s["p"][i]) - (BEFORE - 1), F.lit(1)), F.lit(BEFORE)).alias("before"), F.substring(s["p"][i + 1], 1, AFTER).alias("after"))))[0]
    found = F.transform(placed, lambda s: F.struct(
        s["p"].alias("p"), s["cand"].alias("cand"), F.struct(*[c.alias(n) for n, c in zip(FEATURES, features(s["before"], s["cand"], s["after"], path))]).alias("f")))
    return F.transform(found, lambda s: F.struct(s["p"].alias("p"), s["cand"].alias("cand"), forest.expression(scanner.trees, lambda k: s["f"][FEATURES[k]]).alias("score")))


def findings_column(text: Column, path: Column, scanner: Scanner) -> Column:
    """array<struct<start, length, candidate, score, secret>> of a text's candidates; start counts characters from 0."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))

    def step(s, x):  # places run on from candidate to candidate
        start = s["at"] + F.length(x["p"])
        return F.struct((start + F.length(x["cand"])).alias("at"), F.concat(s["starts"], F.array(start)).alias("starts"))

    both = F.transform(F.array(rated(text, path, scanner)), lambda found: F.struct(found.alias("found"), F.aggregate(found, zero, step)["starts"].alias("starts")))[0]
    whole = F.transform(F.array(both), lambda b: F.zip_with(b["found"], b["starts"], lambda x, start: F.struct(
        start.alias("start"), F.length(x["cand"]).alias("length"), x["cand"].alias("candidate"), x["score"].alias("score"), (x["score"] >= scanner.threshold).alias("secret"))))[0]
    return F.when(text.rlike(CANDIDATE), whole)


def scan(docs: DataFrame, scanner: Scanner, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """doc_id, start, length, candidate, score, secret of every candidate of every whole text.

    Null and empty texts have none; a null path is no path of tests; repeated
    rows are scanned each; an empty table gives no rows. Texts and secrets of any
    length are taken whole, in time linear in the candidates; columns other than
    the three named take no part, whatever they are called.
    """
    path = F.col(path_col).cast("string") if path_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.inline(findings_column(F.col(text_col), path, scanner)))
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), "candidate", "score", "secret")


def redact(docs: DataFrame, scanner: Scanner, *, text_col: str = "text", path_col: str | None = "source", mark: str = "[SECRET]") -> DataFrame:
    """The rows with every secret in the text replaced by ``mark``; other columns pass, null texts stay null."""
    path = F.col(path_col).cast("string") if path_col else F.lit("")
    text = F.col(text_col)
    # What stands between candidates and what becomes of each candidate, joined again, and the rest.
    parts = F.transform(rated(text, path, scanner), lambda x: F.concat(x["p"], F.when(x["score"] >= scanner.threshold, F.lit(mark)).otherwise(x["cand"])))
    rest = F.element_at(F.split(text, CANDIDATE, -1), -1)
    return docs.withColumn(text_col, F.when(text.rlike(CANDIDATE), F.concat(F.array_join(parts, ""), rest)).otherwise(text))
