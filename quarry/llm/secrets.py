"""Secret scans, native: candidates by pattern, then a random forest that removes false positives.

A text is cut at white space. A token is a candidate when it, or the value after its key, has the form of a known
credential, is a long mix of letters and digits, or follows a word such as password or token; and so is each value, known
form and long mix inside a token (compact JSON, code, addresses), which its key or what stands before it names. Features of a candidate:
length, changes between character classes, shares of digits, capitals and hexadecimal digits, distinct characters,
entropy, how much of it words of a dictionary cover, the path it stands in, and the words beside it. The forest is
trained from labelled findings (columns token, before1, before2, after, path, label); without any, from
`example_findings`, which spells out typical true and false findings by rule. All steps are DataFrame functions.

Defined cases: null and empty texts have no candidates; a null path counts as none; rows are documents, so repeated rows
and null ids give findings of their own. An empty table gives none. Extra columns are ignored, and kept by `masked`.
Values have no greatest length. A private key is one candidate from its header to its end, without an end its header is;
headers of certificates and public keys are none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.aligned import is_scan, keyed
from quarry.llm.common import small, text_of, written

TREES, DEPTH, SEED = 40, 8, 11
THRESHOLD = 0.5
MASK = "[SECRET]"
EXAMPLES = 6000
#: Characters of a long value that are looked at in one go.
PIECE = 4096

#: Words that name a secret, and words that name other long strings (fixed values).
SECRET_WORDS = "password passwd passphrase pwd secret token apikey api_key api-key access_key auth authorization bearer credential credentials private_key client_secret key"
OTHER_WORDS = "commit sha sha1 sha256 md5 checksum digest hash uuid guid id etag version build revision example sample placeholder test phone card isbn order invoice url"
#: The dictionary whose cover of a candidate is measured (fixed values).
DICTIONARY = "the and for you your that with this from have not are was but all can her his one our out day get has him how man new now old see two way who boy did its let put say she too use user name pass word admin test demo example sample change here insert enter value string number file path data time date main home page index image color style class public private static void return import export function object array list config setting default server client host port local remote build version release model train label text token secret login account email mail http https www com org net html json xml src lib bin usr var tmp img section chapter figure table order invoice customer"
#: Forms of known credentials (fixed values).
KNOWN = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|[sr]k_(?:live|test)_[0-9A-Za-z]{16,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}|-----BEGIN"
#: A token: what opens it, perhaps a key and = or :, what opens the value, the value, what closes it.
TOKEN = r"""^[^A-Za-z0-9_-]*(?:([A-Za-z_][A-Za-z0-9_.-]{0,63})["']?(?:=|:|=>|:=)["']?)?([A-Za-z0-9_+/-][A-Za-z0-9+/=_.~!@$%^*-]*?[A-Za-z0-9=_-])[^A-Za-z0-9]*$"""
#: A private key in a text: from its header to its end, or the header alone where no end follows before the next header.
PEM_START = r"(?=-----BEGIN )"
PEM = r"^(-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z0-9 ]*(?:-----(?:[\s\S]*?-----END [A-Z0-9 ]*-----)?)?)"
#: Anywhere in a token: perhaps a key and = or :, and the value; and a run that may be a long mix.
PART = r"""(?:([A-Za-z_][A-Za-z0-9_.-]{0,63})["']?(?:=>|:=|=|:)["']?)?([A-Za-z0-9_+/-][A-Za-z0-9+/=_.~!@$%^*-]*)"""
#: What no value ends with.
CLOSING = "+/.~!@$%^*"
#: A key and its value in quotes, which may hold any character but those.
QUOTED = r"""([A-Za-z_][A-Za-z0-9_.-]{0,63})["']?(?:=>|:=|=|:)(["'])([^"']*[^A-Za-z0-9+/=_.~!@$%^*"'-][^"']*)\2"""
RUN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
MIXED = r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/=_-]{16,}$"

COUNTS = ["length", "changes", "digits", "capitals", "hexadecimal", "distinct", "entropy", "covered", "vowels", "separators", "known", "secret_word", "other_word", "secret_path", "runs"]


def _word(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9_-]", ""))


def _any(words: str) -> str:
    return "(?:^|[_.-])(?:" + "|".join(words.split()) + ")(?:$|[_.-])"


def _parsed(tokens: DataFrame) -> DataFrame:
    """tokens (token, before1, before2, after, path, ...) with key, value and the words that may name the value."""
    t = tokens.withColumn("key", F.regexp_extract("token", TOKEN, 1)).withColumn("value", F.regexp_extract("token", TOKEN, 2))
    t = t.withColumn("value", F.when(F.col("value") == "", F.col("token")).otherwise(F.col("value")))
    # In `key = value` the operator stands between.
    operator = F.col("before1").rlike(r"^(=|:|=>|:=|is)$")
    named = F.when(F.col("key") != "", F.lower("key")).when(operator, _word(F.col("before2"))).otherwise(_word(F.col("before1")))
    return t.withColumn("named", named).withColumn("beside", F.concat_ws(" ", "named", _word(F.col("before1")), _word(F.col("before2")), _word(F.col("after"))))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _forms(parsed: DataFrame) -> DataFrame:
    """parsed (of `_parsed`) with a row for each candidate of a token: the token's value, its parts, known forms and long mixes.

    A value counts once a token. A part without a key is named by the part before it, the first by what stands before the token."""
    token, first = F.col("token"), F.struct("key", "value", "named")
    found = lambda pattern, group: F.regexp_extract_all(token, F.lit(pattern), F.lit(group))
    form = lambda key, value, named: F.struct(key.alias("key"), value.alias("value"), named.alias("named"))
    parts = _let(
        F.arrays_zip(found(PART, 1).alias("key"), found(PART, 2).alias("value")),
        lambda a: F.transform(a, lambda x, i: form(x["key"], F.rtrim(x["value"], F.lit(CLOSING)), F.when(x["key"] != "", F.lower(x["key"])).when(i > 0, _word(F.get(a, i - 1)["value"])).otherwise(F.col("named")))),
    )
    quoted = F.transform(F.arrays_zip(found(QUOTED, 1).alias("key"), found(QUOTED, 3).alias("value")), lambda x: form(x["key"], x["value"], F.lower(x["key"])))
    # Headers of keys are found by `_pem`, in the text.
    inner = F.concat(F.filter(found(f"({KNOWN})", 1), lambda v: ~v.startswith("-----")), found(f"({RUN})", 1))
    among = lambda a: F.transform(inner, lambda v: _let(F.get(F.filter(a, lambda x: F.contains(x["value"], v)), F.lit(0)), lambda x: form(F.coalesce(x["key"], F.lit("")), v, F.coalesce(x["named"], F.col("named")))))
    every = F.filter(_let(parts, lambda a: F.concat(F.array(first), quoted, a, among(a))), lambda x: (x["value"] != "-----BEGIN") & _is_candidate(x["value"], x["named"]))
    once = F.aggregate(every, F.filter(F.array(first), lambda x: F.lit(False)), lambda a, x: F.when(F.exists(a, lambda y: y["value"] == x["value"]), a).otherwise(F.concat(a, F.array(x))))
    out = parsed.withColumn("form", F.explode(once))
    beside = F.concat_ws(" ", "form.named", _word(F.col("before1")), _word(F.col("before2")), _word(F.col("after")))
    return out.select(*(c for c in parsed.columns if c not in ("key", "value", "named", "beside")), "form.key", "form.value", "form.named", beside.alias("beside"))


def _pem(docs: DataFrame, *columns: str) -> DataFrame:
    """docs (columns, path, t) to candidates: private keys, each from its header to its end. word is where the header begins."""
    parts = F.split("t", PEM_START)
    before = lambda i: F.array_join(F.slice(F.col("parts"), F.lit(1), i), "")
    blocks = F.transform(F.col("parts"), lambda p, i: F.struct(i.alias("i"), F.regexp_extract(p, PEM, 1).alias("value")))
    d = docs.where(F.contains("t", F.lit("-----BEGIN "))).select(*columns, "path", parts.alias("parts"))
    d = d.select(*columns, "path", "parts", F.explode(F.filter(blocks, lambda b: b["value"] != "")).alias("b"))
    words = F.split(before(F.col("b.i")), r"[\s]+")
    word = lambda k: F.get(words, F.size(words) - k)
    none = F.lit("")
    found = d.select(*columns, (F.size(words) - 1).alias("word"), F.col("b.value").alias("token"), word(2).alias("before1"), word(3).alias("before2"), F.lit(None).cast("string").alias("after"), "path", none.alias("key"), F.col("b.value").alias("value"), F.lit("private_key").alias("named"))
    return found.withColumn("beside", F.concat_ws(" ", "named", _word(F.col("before1")), _word(F.col("before2")), none))


def _is_candidate(value: Column, named: Column) -> Column:
    return value.rlike(f"^(?:{KNOWN})") | value.rlike(MIXED) | ((F.octet_length(value) >= 8) & named.rlike(_any(SECRET_WORDS)))


def candidates(documents: DataFrame, path: str | None = None, *columns: str) -> DataFrame:
    """(columns, word, token, before1, before2, after, path, key, value, named, beside): one row a candidate, several a word perhaps; word counts from 0.

    A cheap length test comes first, so most tokens cost a comparison; neighbours are looked up in the text's own array."""
    w = F.split(text_of("text"), r"[\s]+")
    docs = documents.select(*columns, (F.col(path) if path else F.lit(None).cast("string")).alias("path"), text_of("text").alias("t"), w.alias("w"))
    at = docs.select(*columns, "path", "w", F.posexplode_outer("w").alias("word", "token"))
    at = at.where((F.octet_length("token") >= 8) & F.col("token").rlike(rf"[0-9]|[a-z][A-Z]|[=:].|{KNOWN}"))
    at = at.select(*columns, "word", "token", F.get("w", F.col("word") - 1).alias("before1"), F.get("w", F.col("word") - 2).alias("before2"), F.get("w", F.col("word") + 1).alias("after"), "path")
    return _forms(_parsed(at)).unionByName(_pem(docs.drop("w"), *columns))


def _share(pattern: str) -> Column:
    return F.length(F.regexp_replace("value", f"[^{pattern}]", "")) / F.col("length")


def _distinct(v: Column) -> Column:
    """The distinct characters of v in order of first place. Long values go by pieces, so no array has an entry for each character."""
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1)), F.lit(PIECE)), lambda i: F.array_join(F.array_distinct(F.split(F.substring(v, i, F.lit(PIECE)), "")), ""))
    return F.array_distinct(F.split(F.when(F.length(v) > PIECE, F.array_join(pieces, "")).otherwise(v), ""))


def with_features(found: DataFrame) -> DataFrame:
    """found (of `candidates`) with the columns COUNTS, all doubles."""
    v = F.col("value")
    f = found.withColumn("length", F.length(v).cast("double"))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]+", "a"), "[A-Z]+", "B"), "[0-9]+", "0"), "[^aB0]+", "_")
    chars = _distinct(v)
    counts = F.transform(chars, lambda c: (F.length(v) - F.length(F.replace(v, c, F.lit("")))) / F.col("length"))
    entropy = -F.aggregate(counts, F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    cover = F.length(F.array_join(F.regexp_extract_all(F.lower(v), F.lit("(" + "|".join(sorted(DICTIONARY.split(), key=len, reverse=True)) + ")"), F.lit(1)), "")) / F.col("length")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    made = {
        "changes": (F.length(shape) - 1) / F.col("length"), "digits": _share("0-9"), "capitals": _share("A-Z"), "hexadecimal": _share("0-9a-f"),
        "distinct": F.size(chars) / F.col("length"), "entropy": entropy, "covered": cover, "vowels": _share("aeiouAEIOU"),
        "separators": _share("_./~-"), "known": flag(v.rlike(f"^(?:{KNOWN})")), "secret_word": flag(F.col("named").rlike(_any(SECRET_WORDS))),
        "other_word": flag(F.exists(F.split("beside", " "), lambda x: x.rlike(_any(OTHER_WORDS)))),
        "secret_path": F.when(F.lower("path").rlike("test|example|sample|doc|fixture|mock"), -1.0).when(F.lower("path").rlike(r"\.env|config|secret|credential|deploy"), 1.0).otherwise(0.0),
        "runs": F.length(F.regexp_replace(v, r"(.)(?!\1\1)", "")) / F.col("length"),
    }
    return f.select("*", *(c.cast("double").alias(n) for n, c in made.items()))


def example_findings(spark: SparkSession, rows: int = EXAMPLES) -> DataFrame:
    """Labelled findings (token, before1, before2, after, path, label) spelt out by rule from the row's number."""
    r = spark.range(rows, numPartitions=4)
    digest = F.sha2(F.col("id").cast("string"), 256)
    base = F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 512))), "+/=", "xYz")
    n = (F.xxhash64("id") % 24 + 24) % 24
    pick = lambda words, salt: F.element_at(F.array(*map(F.lit, words.split())), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words.split()))) + 1).cast("int"))
    name, other = pick("password passwd secret token api_key apikey auth client_secret access_key credential", 1), pick("commit sha256 md5 checksum etag uuid build revision id digest", 2)
    w1, w2, w3 = pick(DICTIONARY, 3), pick(DICTIONARY, 4), pick(DICTIONARY, 5)
    number = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(10**6)).cast("string")
    kinds = [  # (label, token, before1, before2)
        (1, F.concat(F.lit('"'), F.substring(digest, 1, 40), F.lit('"')), F.lit("="), name),
        (1, F.concat(name, F.lit("="), F.substring(digest, 1, 18)), w1, w2),
        (1, F.concat(name, F.lit("="), base.substr(F.lit(1), n + 8)), w1, w2),
        (1, F.concat(F.lit("AKIA"), F.upper(F.substring(digest, 1, 16))), w1, F.lit("key")),
        (1, F.concat(F.lit("AKIA"), F.upper(F.substring(digest, 1, 16))), w1, w2),
        (1, base.substr(F.lit(1), n + 20), F.lit(":"), name),
        (1, base.substr(F.lit(1), F.lit(40)), w1, w2),
        (1, F.concat(F.lit("ghp_"), base.substr(F.lit(1), F.lit(36))), w1, w2),
        (1, F.concat(F.lit("eyJhbGciOi"), base.substr(F.lit(1), F.lit(24)), F.lit("."), base.substr(F.lit(10), F.lit(40)), F.lit("."), base.substr(F.lit(30), F.lit(30))), F.lit("Bearer"), F.lit("Authorization:")),
        (1, F.concat(w1, F.initcap(w2), F.lit("!"), number), F.lit("="), F.lit("password")),
        (1, F.concat(name, F.lit("="), w1, w2, w3, w1), w2, w3),
        (0, F.substring(digest, 1, 40), F.lit("commit"), w1),
        (0, F.concat(other, F.lit(":"), F.substring(digest, 1, 32)), w1, w2),
        (0, digest, F.lit("sha256"), w1),
        (0, F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 4), F.substring(digest, 21, 12)), other, w1),
        (0, F.concat_ws("_", w1, w2, w3, F.substring(number, 1, 2)), w1, w2),
        (0, F.concat(w1, F.initcap(w2), F.initcap(w3), F.substring(number, 1, 1), F.initcap(w1)), w2, w3),
        (0, F.concat(name, F.lit("=your-"), w1, F.lit("-"), name, F.lit("-here1")), w1, w2),
        (0, F.concat(name, F.lit("="), F.repeat(F.lit("x"), 12), F.lit("1")), w1, w2),
        (0, F.concat(name, F.lit(":example"), F.substring(number, 1, 3)), F.lit("for"), F.lit("example")),
        (0, F.concat(F.lit("https://www."), w1, F.lit(".com/"), w2, F.lit("/"), number), w2, w3),
        (0, F.concat(F.lit("/"), w1, F.lit("/"), w2, F.lit("/"), w3, number, F.lit(".html")), w1, F.lit("path")),
        (0, F.concat(F.repeat(F.substring(number, 1, 4), 4), F.lit("ab")), F.lit("card"), w1),
        (0, F.concat(w1, w2, w3, w1, F.substring(number, 1, 2)), w2, w1),
        (0, F.concat(w1, F.lit("-"), w2, F.lit("-"), w3, F.lit("-2024")), w2, w1),
    ]
    kind = F.pmod("id", F.lit(len(kinds)))
    column = lambda i: reduce(lambda e, k: e.when(kind == k, kinds[k][i]), range(1, len(kinds)), F.when(kind == 0, kinds[0][i]))
    label = reduce(lambda e, k: e.when(kind == k, F.lit(kinds[k][0])), range(1, len(kinds)), F.when(kind == 0, F.lit(kinds[0][0])))
    path = pick("src/main.py config/app.yml README.md tests/test_app.py docs/usage.md deploy/prod.env lib/util.js", 6)
    return r.select(column(1).alias("token"), column(2).alias("before1"), column(3).alias("before2"), w3.alias("after"), F.when(F.col("id") % 2 == 0, path).alias("path"), label.cast("double").alias("label"))


def fit(labelled: DataFrame) -> PipelineModel:
    """A forest of TREES trees from labelled findings, which are a bounded set of examples."""
    rows = with_features(_parsed(labelled)).select(*COUNTS, F.col("label").cast("double").alias("label")).na.fill(0.0)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt")
    return Pipeline(stages=[VectorAssembler(inputCols=COUNTS, outputCol="features"), forest]).fit(rows)


def scored(found: DataFrame, model: PipelineModel) -> DataFrame:
    """found with score, the forest's probability that the candidate is a secret, and is_secret."""
    out = model.transform(with_features(found).na.fill(0.0, COUNTS))
    score = vector_to_array("probability")[1]
    return out.select(*found.columns, score.alias("score"), (score >= THRESHOLD).alias("is_secret"))


def secrets(documents: DataFrame, model: PipelineModel | None = None, path: str | None = None) -> DataFrame:
    """Per candidate: doc_id, word (its number in the text, from 0), named, length, value_sha256, score, is_secret. Values stay out."""
    model = model or fit(example_findings(documents.sparkSession))
    out = scored(candidates(documents, path, "doc_id"), model)
    return out.select("doc_id", F.col("word").cast("long").alias("word"), "named", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "is_secret")


def masked(documents: DataFrame, model: PipelineModel | None = None, path: str | None = None) -> DataFrame:
    """documents with MASK in place of every secret; all rows and columns stay, n_chars follows the text."""
    model = model or fit(example_findings(documents.sparkSession))
    documents = documents if is_scan(documents) else written(documents, "input")
    docs = keyed(documents, *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(documents.columns)))
    place = {c: f"c{i}" for i, c in enumerate(documents.columns)}
    texts = docs.select("block", "row", F.col(place["text"]).alias("text"), *([F.col(place[path]).alias("path")] if path else []))
    found = scored(candidates(texts, "path" if path else None, "block", "row"), model).where("is_secret")
    values = found.groupBy("block", "row").agg(F.sort_array(F.collect_set(F.struct(F.length("value").alias("n"), "value")), asc=False).alias("values"))
    values = written(values, "secrets")
    few = small(values, F.aggregate("values", F.lit(0).cast("long"), lambda a, v: a + v["n"] * 4))  # else texts are shuffled, beside the many findings
    both = docs.join(F.broadcast(values) if few else values, ["block", "row"], "left")
    new = F.when(F.col("values").isNull(), F.col(place["text"])).otherwise(F.aggregate("values", F.col(place["text"]), lambda t, v: F.replace(t, v["value"], F.lit(MASK))))
    out = []
    for c, p in place.items():
        if c == "text":
            out.append(new.alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("values").isNull(), F.col(p)).otherwise(F.length(new)).cast(documents.schema[c].dataType).alias(c))
        else:
            out.append(F.col(p).alias(c))
    return both.select(*out)
