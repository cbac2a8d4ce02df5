"""Secrets in texts, with weak candidates reported only where complementary parts of a credential come together.

Strong patterns stand alone. Weak ones (names of accounts, long random strings, addresses of services) are common in
clean text; each is a part of a credential, and is reported when the other parts lie within the same scope. Parts are
intervals; they meet in a join on (document, bin of the text) with a check of the true distance, so a document with
many parts costs no more than the parts that are near each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.sources.staging import stage

#: Patterns and least lengths of the strong kinds, in the order of the report (fixed values).
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12
#: Weak parts: who signs in, what could be a key, and where it is used.
LOGIN = r"""(?:[Uu][Ss][Ee][Rr](?:[Nn][Aa][Mm][Ee]|_?[Ii][Dd])?|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd])["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
RANDOM = r"[A-Za-z0-9+/]{32,}"
ENDPOINT = r"""(?:https?|ftps?|sftp|ssh|ldaps?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3)://[^\x20\t\r\n"'<>]+"""
KINDS = ("assign", "access", "hex", "login", "random", "endpoint")
#: Code points between two parts of one credential, at most.
SCOPE = 300


def found(text: Column, pattern: str, hint: Column | None = None, value: str | None = None) -> Column:
    """``array<struct<start, end, value>>`` of the leftmost non-overlapping matches, in code points, end exclusive.

    The text between matches gives their places: pieces and matches alternate, and their lengths add up. ``hint`` is a
    cheap condition that every text with a match meets. ``value`` names the group whose text is kept.
    """
    regex = F.lit(pattern)
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p))
    sizes = F.transform(F.regexp_extract_all(text, regex, F.lit(0)), lambda m: F.char_length(m))
    values = F.regexp_extract_all(text, regex, F.lit(int(value or 0)))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["0"]
        end = start + x["1"]
        one = F.struct(start.alias("start"), end.alias("end"), x["2"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    # The piece after the last match has no match beside it and falls away.
    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(sizes)).alias("0"), sizes.alias("1"), values.alias("2"))
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    spans = F.aggregate(zipped, start, add, lambda acc: acc["out"])
    present = text.rlike(pattern) if hint is None else hint & text.rlike(pattern)
    return F.when(present, spans).otherwise(empty)


def _plain(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def _join(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed."""
    names = F.array(*map(F.lit, KINDS))
    told = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return F.array_join(told, ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, key, assign, access, hex, login, random, endpoint``: all matches of every whole text, as arrays of spans.

    Equal rows share a ``key``. Long random strings need a digit, a capital and a small letter, and the strong matches
    are left out of them.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    marked = t.contains(":") | t.contains("=")
    assign = F.filter(found(t, ASSIGN, marked, "2"), lambda s: F.char_length(s["value"]) >= LEAST_VALUE)
    random = F.filter(
        found(t, RANDOM), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]")
    )
    rows = docs.select(
        F.col(id_col),
        F.struct(F.xxhash64(t, F.col(id_col)).alias("a"), F.xxhash64(F.lit(7), t, F.col(id_col)).alias("b")).alias("key"),
        _plain(assign, "assign").alias("assign"),
        _plain(found(t, ACCESS, t.contains("AKIA")), "access").alias("access"),
        _plain(found(t, HEX), "hex").alias("hex"),
        _plain(found(t, LOGIN, marked), "login").alias("login"),
        _plain(random, "random").alias("random"),
        _plain(found(t, ENDPOINT, t.contains("://")), "endpoint").alias("endpoint"),
    )
    inside = lambda s: F.exists(F.concat("assign", "access", "hex"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return rows.withColumn("random", F.filter("random", lambda s: ~inside(s)))


def link(found_spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``key, linked``: the weak spans of every text that complementary parts within ``scope`` code points confirm.

    Identifiers (access, login), secrets (assign, random) and endpoints complement each other: a login needs a secret, a
    random string an identifier or an endpoint, an endpoint a secret.
    """
    roles = {"access": "id", "login": "id", "assign": "secret", "random": "secret", "endpoint": "endpoint"}
    count = lambda role: sum(F.size(k) for k, r in roles.items() if r == role)
    several = (F.size("random") + F.size("login") + F.size("endpoint") > 0) & (count("secret") > 0) & (count("id") + count("endpoint") > 0)

    def tag(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(roles[kind]).alias("role"), s.alias("s")))

    tagged = F.concat(*map(tag, roles))
    parts = (
        found_spans.where(several).select("key", F.explode(tagged).alias("p")).distinct()
        .select("key", F.col("p.role").alias("role"), F.col("p.s.start").alias("start"), F.col("p.s.kind").alias("kind"), F.col("p.s.end").alias("end"))
    )
    # Bins are as wide as the scope. A part takes every bin it touches, and looks for others in the bins of its reach.
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope)))
    weak = parts.where(F.col("kind") >= KINDS.index("login"))
    looks = weak.withColumn("bin", bins(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope))
    holds = parts.select(
        "key", *(F.col(c).alias(f"o_{c}") for c in ("role", "start", "end")), bins(F.col("start"), F.col("end") - 1).alias("bin")
    )
    near = (F.col("o_start") <= F.col("end") + scope) & (F.col("o_end") + scope >= F.col("start"))
    complement = (F.col("role") != F.col("o_role")) & ((F.col("role") == "secret") | (F.col("o_role") == "secret"))
    met = looks.join(holds, ["key", "bin"]).where(near & complement)
    return met.groupBy("key").agg(F.collect_set(F.struct("start", "kind", "end")).alias("linked"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``id, n_assign, n_access, n_hex, base_sha256, spans`` of every whole text; a null text is an empty one.

    Spans are ``kind:start:end`` in code points with the end exclusive, by start and then kind. The strong kinds (assign,
    access, hex) are always there and alone give ``base_sha256``; login, random and endpoint are there when linked.
    Other columns are ignored; repeated rows give repeated results; no row, no result.
    """
    rows = stage(scan(docs, id_col, text), "secret-spans")
    linked = link(rows, scope)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    both = rows.join(linked, "key", "left")
    base = F.concat("assign", "access", "hex")
    return both.select(
        id_col,
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_join(base).cast("binary"), 256).alias("base_sha256"),
        _join(F.concat(base, F.coalesce("linked", none))).alias("spans"),
    )


def _spans_sql(kind: str, pattern: str, group: int, where: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT r, '{kind}' AS kind, {KINDS.index(kind)} AS k, start, start + length(m[i]) AS stop FROM (
    SELECT r, m, v, i, (coalesce(list_sum(list_transform(pieces[1:i], lambda x: length(x))), 0)
      + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
    FROM (SELECT r, pieces, m, v, unnest(range(1, len(m) + 1)) AS i
      FROM (SELECT r, string_split_regex(s, '{quoted}') AS pieces, regexp_extract_all(s, '{quoted}', 0) AS m,
        regexp_extract_all(s, '{quoted}', {group}) AS v FROM t)))
  WHERE {where}"""


ORACLE_SQL = (
    "WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS s FROM documents),\nstrong AS ("
    + " UNION ALL ".join(
        [
            _spans_sql("assign", ASSIGN, 2, f"length(v[i]) >= {LEAST_VALUE}"),
            _spans_sql("access", r"AKIA[A-Z0-9]+", 0, "length(m[i]) >= 18"),
            _spans_sql("hex", r"[0-9a-f]{16,}", 0, "true"),
        ]
    )
    + "),\nweak AS ("
    + " UNION ALL ".join(
        [
            _spans_sql("login", LOGIN, 0, "true"),
            "SELECT * FROM ("
            + _spans_sql("random", RANDOM, 0, "m[i] SIMILAR TO '.*[0-9].*' AND m[i] SIMILAR TO '.*[A-Z].*' AND m[i] SIMILAR TO '.*[a-z].*'")
            + ") w WHERE NOT EXISTS (SELECT 1 FROM strong b WHERE b.r = w.r AND b.start < w.stop AND w.start < b.stop)",
            _spans_sql("endpoint", ENDPOINT, 0, "true"),
        ]
    )
    + f"""),
parts AS (SELECT *, CASE WHEN kind IN ('access', 'login') THEN 'id' WHEN kind IN ('assign', 'random') THEN 'secret' ELSE kind END AS role
  FROM (SELECT * FROM strong WHERE kind <> 'hex' UNION ALL SELECT * FROM weak)),
linked AS (SELECT DISTINCT w.r, w.kind, w.k, w.start, w.stop FROM parts w JOIN parts o ON w.r = o.r AND w.role <> o.role
  AND (w.role = 'secret' OR o.role = 'secret') AND o.start <= w.stop + {SCOPE} AND o.stop + {SCOPE} >= w.start WHERE w.k >= 3),
told AS (SELECT r, true AS base, * EXCLUDE r FROM strong UNION ALL SELECT r, false, * EXCLUDE r FROM linked),
per_row AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, k) FILTER (base) AS base,
    string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, k) AS spans
  FROM told GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN per_row USING (r)
"""
)
