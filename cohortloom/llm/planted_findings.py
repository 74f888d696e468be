"""Labelled findings for the secret scan: short texts with one planted value each, whose label is known by its making.

A kind is a sentence with a value in it. Values are made from hashes of the row's number, so the table is the same every
time; ``per_kind`` bounds it. Kinds know nothing of the features: secrets and harmless values share shapes (hex, base64,
long mixed words), places (assigned, quoted, in prose, in addresses) and key words, and differ as they do in real files.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.labels import first_match

# Sentences with one value V; A and B are words of the surroundings, K is a name of a secret, W a plain word, N a number, S some secret.
SECRETS = {
    "quoted hex": ('A K = "V" B', "hex40"), "plain hex": ("A K=V B", "hex32"), "long hex": ("A K: V B", "hex64"), "short hex": ("A K=V, B", "hex16"),
    "cloud id": ("A V B", "cloud"), "cloud id in json": ('{"idN":"V"} B', "cloud"), "code host": ("A V B", "codehost"), "chat": ("A W=V B", "chat"),
    "payment": ('A "V" B', "payment"), "map": ("https://maps.W.com/api?key=V B", "map"), "json": ('{"K":"V","W":"N"}', "base64"),
    "base64": ("A K = V B", "base64"), "header": ("Authorization: Bearer V B", "base64url"), "url": ("A postgres://W:V@W.host:N/W B", "password"),
    "said": ("A the password is V B", "password"), "named": ("A password: V B", "password"), "assigned": ("password=V B", "password"), "hidden": ("A pwd V B", "password"),
    "environment": ("export K='V' B", "base64url"),
}
HARMLESS = {
    "checksum": ("A sha256 V B", "hex64"), "commit": ("A commit V B", "hex40"), "digest": ('A checksum = "V" B', "hex32"), "tag": ('A etag="V" B', "hex32"),
    "id": ("A id=V B", "uuid"), "request": ("A request: V B", "uuid"), "card": ("A V B", "digits16"), "phone": ("A call +V B", "digits12"),
    "time": ("A at V B", "time"), "version": ("A W version=V B", "version"), "mail": ("A V B", "mail"), "page": ("A see V B", "page"),
    "file": ("A V B", "file"), "name": ("A V() B", "camel"), "size": ("A width=V B", "size"), "colour": ("A color=#V B", "hex6"),
    "placeholder": ("A K=V B", "placeholder"), "quoted placeholder": ('A K = "V" B', "placeholder"), "key in prose": ("A the password V B", "word"),
    "token in prose": ("A token V B", "word"), "secret in prose": ("A W secret W V B", "word"), "assigned word": ("A W=V B", "word"),
    "assigned number": ("A W=V B", "digits12"), "picture": ("A src=V B", "base64url"),
    "card after a secret": ('A K = "S" V B', "digits16"), "mail after a secret": ('A K = "S" V B', "mail"), "number after a secret": ("A K=S V B", "digits12"),
    "word after a secret": ("A K=S W V B", "word"), "mail near a key": ("A K W V B", "mail"), "card near a key": ("A K W V B", "digits16"),
}
_KEYS = "token api_key secret auth_token access_key password client_secret apiKey AWS_SECRET_ACCESS_KEY db_password pwd".split()
_WORDS = "river mountain window reader market garden letter winter bridge silver branch corner island planet summer valley".split()
_PLACEHOLDERS = ["changeme", "example", "YOUR_API_KEY_HERE", "<your-token>", "xxxxxxxxxxxx", "required", "********", "placeholder", "undefined", "$SECRET_NAME", "${env.KEY}", "reset"]
_PATHS = ["src/main", "config/prod", "home", "logs/app", "docs/guide", "test/data", "examples/basic"]


def _hash(salt: str) -> Column:
    return F.sha2(F.concat_ws("/", F.lit(salt), "kind", F.col("id").cast("string")), 256)


def _pick(salt: str, values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.xxhash64(_hash(salt)), F.lit(len(values))).cast("int"))


def _values() -> dict[str, Column]:
    """Each shape of a value from hashes."""
    hex_, more = _hash("v"), _hash("w")
    mixed = F.concat(F.base64(F.unhex(hex_)), F.base64(F.unhex(more)))
    letters, number = F.regexp_replace(mixed, "[^A-Za-z0-9]", ""), F.regexp_replace(F.concat(hex_, more), "[^0-9]", "")
    capital, word = F.upper(letters), _pick("p", _WORDS)
    cut = lambda c, n: F.substring(c, 1, n)
    return {
        "hex6": cut(hex_, 6), "hex16": cut(hex_, 16), "hex32": cut(hex_, 32), "hex40": cut(hex_, 40), "hex64": hex_, "digits12": cut(number, 12), "digits16": cut(number, 16),
        "uuid": F.regexp_replace(cut(hex_, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), "base64": cut(mixed, 40),
        "base64url": F.translate(cut(mixed, 43), "+/", "-_"), "cloud": F.concat(F.lit("AKIA"), cut(capital, 16)),
        "codehost": F.concat(F.lit("ghp_"), cut(letters, 36)), "chat": F.concat_ws("-", F.lit("xoxb"), cut(number, 11), cut(letters, 24)),
        "payment": F.concat(F.lit("sk_live_"), cut(letters, 24)), "map": F.concat(F.lit("AIza"), F.translate(cut(mixed, 35), "+/", "-_")),
        "password": F.concat(F.initcap(cut(word, 5)), F.regexp_replace(cut(number, 4), "^0", "7"), _pick("s", ["", "!", "#", "_x", "Zq"])),
        "time": F.concat(F.lit("2024-0"), F.pmod(F.xxhash64(hex_), F.lit(9)) + 1, F.lit("-11T"), cut(number, 2), F.lit(":"), F.substring(number, 3, 2), F.lit(":00Z")),
        "version": F.concat_ws(".", cut(number, 1), F.substring(number, 2, 2), F.substring(number, 4, 3), F.lit("beta")),
        "mail": F.concat(word, F.lit("."), cut(number, 3), F.lit("@mail.example.com")), "page": F.concat(F.lit("https://www."), word, F.lit(".com/a/"), cut(number, 8)),
        "file": F.concat(word, F.lit("_"), cut(number, 8), F.lit("_final.txt")), "camel": F.concat(word, F.initcap(_pick("q", _WORDS)), F.lit("Handler"), cut(number, 2)),
        "size": F.concat(cut(number, 4), F.lit("px")), "placeholder": _pick("h", _PLACEHOLDERS), "word": word,
    }


def planted(spark: SparkSession, per_kind: int = 150) -> DataFrame:
    """``doc_id``, ``text``, ``source``, ``value``, ``label``, ``kind``: ``per_kind`` texts of every kind."""
    kinds = [(kind, _tokens(sentence), shape, label) for label, named in ((1.0, SECRETS), (0.0, HARMLESS)) for kind, (sentence, shape) in named.items()]
    rows = spark.createDataFrame(kinds, "kind string, tokens array<string>, shape string, label double")
    rows = rows.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(per_kind - 1)))).repartition(8, "id")
    rows = rows.withColumn("value", first_match((F.col("shape") == shape, value) for shape, value in _values().items()))
    pieces = F.struct(F.col("value").alias("V"), F.concat_ws(" ", _pick("a", _WORDS), _pick("b", _WORDS), _pick("c", _WORDS)).alias("A"),
                      F.concat_ws(" ", _pick("d", _WORDS), _pick("e", _WORDS)).alias("B"), _pick("k", _KEYS).alias("K"), _pick("f", _WORDS).alias("W"), F.substring(_hash("t"), 1, 40).alias("S"),
                      F.pmod(F.xxhash64(_hash("n")), F.lit(900)).cast("string").alias("N"))
    text = F.array_join(F.transform("tokens", lambda t: first_match(((t == n, F.col("p")[n]) for n in "VABKWNS"), t)), "")
    rows = rows.withColumn("p", pieces).withColumn("text", text)
    return rows.select(F.concat_ws(":", "kind", F.col("id").cast("string")).alias("doc_id"), "text", _pick("o", _PATHS).alias("source"), "value", "label", "kind")


def _tokens(sentence: str) -> list[str]:
    """The sentence cut at its one-letter names, which stand beside no other letter."""
    return [t for t in re.split(r"(?<![A-Za-z])([VABKWNS])(?![A-Za-z])|(?<=[a-z])(N)(?![A-Za-z])", sentence) if t]
