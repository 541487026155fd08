"""Queries of text detection over documents, pages and lines made to hit every pattern."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CustomPattern, MaskingConfig
from ..functions import registry as reg
from ..functions.dialect import DUCK, text
from ..functions.spans import column_sql, line_sql, spans_sql
from ..operators import detect
from ..sources.lines import partitions_of

AS_OF = "2025-06-15"

#: Lines in which every pattern has a match, in prose, CSV, JSON and XML.
LINES = (
    "Contact our member john.doe@company.org or call 555-123-4567 today",
    'user record {"email": "ann@firm.net", "ssn": "123-45-6780", "dob": "1986-05-28", "phone": "0412345678"}',
    "<user><dob>28/05/1975</dob><card>4532 1234 5678 9010</card><iban>GB82WEST12345698765432</iban></user>",
    "dob: 28-May-1986, birth 1990-13-45, born 12.03.1980, birthday 2015-01-01",
    "passport N1234567, US X12345678, UK 925665416, EU AB12CD34E, Passport: PA9876543 ID# ABC123456",
    "License: AB123456, Lic# QLD998877, DL: K12345678, Driver LICENCE12345, National ID 887766554",
    "uk licence MORGA657054SM9IJ and NI number AB123456C and nmi 6102345678A",
    "BSB 063-123 and Account: 12345678, ACC 987654, A/C 4455667, bsb 062 000",
    "cards 4111-1111-1111-1111 5500 0000 0000 0004 3714 496353 98431 6011000990139424",
    "TFN 123 456 782, ABN 51 824 753 556, medicare 2123 45670 1, phone 0298765432 +61 412 345 678",
    "Client No: 445566, Customer ID 778899, Ref: INV20230001, Policy No: POL887766, TXN ID: TX9988776655",
    "swift CTBAAU2SXXX, iban DE89370400440532013000, routing 021000021, ip 192.168.1.50 and 10.0.0.256",
    "ipv6 2001:0db8:85a3:0000:0000:8a2e:0370:7334 lives at 42 Wallaby Way Lane or 7 Main STREET",
    "name,card,ssn\nBob,4929963689861572,987-65-4320\nSample test,4000056655665556,111-11-1111",
    '{"accountNumber": "123456", "customer": {"card": "5425233430109903"}, "bsb": "345-678"}',
    "<bsb>345-678</bsb><accountNumber>00012345</accountNumber><client>CTBAAU2S</client>",
    "private account 6011000990139424 of client, personal phone +1 (212) 555-0187 x",
)

_LINES_SQL = " UNION ALL ".join(f"SELECT 'line' AS src, cast({i} AS bigint) AS id, {text(x)} AS text" for i, x in enumerate(LINES)).replace("\n", "' || chr(10) || '")
TEXTS_SQL = f"SELECT 'doc' AS src, doc_id AS id, text FROM documents UNION ALL SELECT 'page' AS src, page_id AS id, html AS text FROM pages UNION ALL {_LINES_SQL}"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"), "text")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lit("page").alias("src"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    lines = spark.createDataFrame([("line", i, x) for i, x in enumerate(LINES)], "src string, id long, text string")
    rows = docs.unionAll(pages).unionAll(lines)
    cores = spark.sparkContext.defaultParallelism
    # either way the projections above aren't copied into each branch of the union
    return rows.repartition(cores) if partitions_of(docs) < cores else detect.held(rows, "text")


def _spans_duck(d: reg.Detector, source: str = "texts") -> str:
    rx = DUCK.regex(d.re2)
    return f"""SELECT src, id, text, m[i] AS value,
      cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS int) AS pos
      FROM (SELECT src, id, text, m, g, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT src, id, text, regexp_extract_all(text, {rx}) AS m, string_split_regex(text, {rx}) AS g FROM {source} WHERE regexp_matches(text, {rx})))"""


def _span_query(d: reg.Detector) -> tuple[Callable, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        maybe = d.hint("text", "lower(text)")
        found = texts(spark, sf_dir).select("src", "id", F.explode(F.expr(spans_sql("text", d.java, maybe=maybe))).alias("s"))
        return found.select("src", "id", "s.value", "s.pos")

    return run, f"WITH texts AS ({TEXTS_SQL}) SELECT src, id, value, pos FROM ({_spans_duck(d)})"


def _words(x: str, words: tuple[str, ...]) -> str:
    return f"regexp_matches({x}, '{'|'.join(words)}')"


def scored_duck(config: MaskingConfig) -> str:
    """Common table expressions: texts, found, windows, scored."""
    detectors = reg.REGISTRY.enabled(config.effective_types())
    found = " UNION ALL ".join(f"SELECT {d.priority} AS priority, '{d.type}' AS type, {d.prior!r}::DOUBLE AS prior, * FROM ({_spans_duck(d)})" for d in detectors)
    repeated = "|".join(f"{i}{{5,}}" for i in range(10))
    sequences = "0123|1234|2345|3456|4567|5678|6789|7890|9876|8765|7654|6543|5432|4321|3210"
    free = ", ".join(text(t) for t in reg.SEQUENCES_ALLOWED)
    risky = ", ".join(text(t) for t in reg.HIGH_RISK)
    needs = " ".join(
        f"WHEN structure = '{s}' THEN CASE WHEN type IN ({risky}) THEN {detect.threshold_of(config.confidence_threshold, s, reg.HIGH_RISK[0], config.mode)!r}::DOUBLE ELSE {detect.threshold_of(config.confidence_threshold, s, '', config.mode)!r}::DOUBLE END"
        for s in detect.STRUCTURES
    )
    as_of = f"date '{config.as_of}'"
    return rf"""WITH texts AS ({TEXTS_SQL}), found AS ({found}),
    windows AS (SELECT *,
      substring(text, greatest(pos - 300, 0) + 1, least(pos, 300)) AS b300, substring(text, pos + length(value) + 1, 50) AS a50,
      substring(text, greatest(pos - 100, 0) + 1, least(pos, 100)) AS b100, substring(text, pos + length(value) + 1, 100) AS a100,
      lower(substring(text, greatest(pos - 100, 0) + 1, least(pos, 100) + length(value) + 100)) AS context,
      regexp_replace(value, '\D', '', 'g') AS digits, regexp_replace(value, '\W', '', 'g') AS word FROM found),
    gates AS (SELECT *,
      (regexp_matches(b300, '<[^>]*\z') AND contains(a50, '>')) OR (contains(b300, '"') AND regexp_matches(a50, '^\s*"?\s*:')) AS inside_name,
      type <> 'dateOfBirth' OR ({_words('lower(b100)', reg.BIRTH_WORDS)} AND
        coalesce(try_cast(CASE WHEN regexp_matches(value, '^\d{{4}}[-/]\d{{2}}[-/]\d{{2}}$') THEN replace(value, '/', '-')
          WHEN regexp_matches(value, '^\d{{2}}[-/]\d{{2}}[-/]\d{{4}}$') THEN value[7:10] || '-' || value[4:5] || '-' || value[1:2] END AS date) IS NOT NULL
          AND year({as_of}) - try_cast(CASE WHEN regexp_matches(value, '^\d{{4}}') THEN value[1:4] ELSE value[7:10] END AS int) BETWEEN 18 AND 120, false)) AS birth,
      CASE WHEN regexp_matches(value, '{repeated}') THEN 0.2::DOUBLE WHEN type NOT IN ({free}) AND regexp_matches(digits, '{sequences}') THEN 0.3::DOUBLE
        WHEN regexp_matches(value, '(?i)^(XXXX|0000|N/A|TBD|TODO|test|example|dummy|placeholder|sample)') THEN 0.1::DOUBLE
        WHEN length(word) > 2 AND replace(word, word[1:1], '') = '' THEN 0.15::DOUBLE ELSE 1.0::DOUBLE END AS anomaly,
      CASE WHEN regexp_matches(b100, '<[^>]+>\s*\z') AND regexp_matches(a100, '^\s*</') THEN 'xml' WHEN regexp_matches(b100, '[{{,]\s*"[^"]+"\s*:\s*"?\s*\z') THEN 'json'
        WHEN regexp_matches(b100, ',\s*\z') OR regexp_matches(a100, '^\s*,') THEN 'csv' ELSE '{"xml" if config.inside_cdata else "plain_text"}' END AS structure FROM windows),
    scores AS (SELECT *,
      CASE WHEN anomaly < 0.5 THEN anomaly * 0.5::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE, prior
        + CASE WHEN {_words('context', reg.POSITIVE_WORDS)} THEN 0.1::DOUBLE ELSE 0::DOUBLE END - CASE WHEN {_words('context', reg.NEGATIVE_WORDS)} THEN 0.3::DOUBLE ELSE 0::DOUBLE END
        + CASE WHEN {_words('context', reg.FIELD_WORDS)} THEN 0.2::DOUBLE ELSE 0::DOUBLE END)) END AS confidence,
      CASE {needs} END AS threshold FROM gates),
    scored AS (SELECT *, NOT inside_name AND birth AND confidence >= threshold AS decided FROM scores),
    ranked AS (SELECT *, decided AND row_number() OVER (PARTITION BY src, id, value, decided ORDER BY priority, pos) = 1 AS first FROM scored)"""


def _matches_duck(rx: str, groups: int, source: str = "texts") -> str:
    """src, id, text, whole match, its groups g1.., pos: the matches of an expression."""
    caught = "".join(f", regexp_extract_all(text, '{rx}', {i}) AS a{i}" for i in range(1, groups + 1))
    own = "".join(f", a{i}[i] AS g{i}" for i in range(1, groups + 1))
    return f"""SELECT src, id, text, m[i] AS whole{own}, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS int) AS pos
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT src, id, text, regexp_extract_all(text, '{rx}') AS m, string_split_regex(text, '{rx}') AS g{caught} FROM {source} WHERE regexp_matches(text, '{rx}')))"""


def _type_duck(name: str) -> str:
    """The type a field's name stands for."""
    known = rf"regexp_replace(lower({name}), '[_\s-]', '', 'g')"
    cases = []
    for category, words in reg.COLUMN_CATEGORIES.items():
        alternatives = "|".join(w.replace(" ", "").replace("_", "").replace("-", "") for w in words)
        result = f"CASE WHEN contains({known}, 'nmi') THEN 'nmi' ELSE 'accountNumber' END" if category == "identifier" else text(reg.CATEGORY_TYPES.get(category, "custom"))
        cases.append(f"WHEN regexp_matches({known}, '{alternatives}') THEN {result}")
    return f"CASE {' '.join(cases)} ELSE 'custom' END"


def masked_duck(config: MaskingConfig) -> str:
    """After scored_duck: claimed, the edits of each text, and masked(src, id, text, masked_text, n, has_overlap), for texts without CDATA.

    A match of a tag's content ends at the next closing tag; one of another name
    is no field. Edits are applied as they come: those that keep the length
    first, each kind from the last to the first.
    """
    types = config.effective_types()
    off = ", ".join(text(k) for k, v in types.items() if v is False)
    known = sorted({*reg.CATEGORY_TYPES.values(), "nmi", "custom"})
    fields = []
    for k, (rx, groups, where) in enumerate(((r'"([^"]+)"\s*:\s*"([^"]+)"', 2, "true"), (r'"([^"]+)"\s*:\s*([0-9\s-]+)', 2, "true"), (r"<([^>\s/]+)>([^<]+)</([^>]*)>", 3, "g1 = g3"))):
        fields.append(f"SELECT src, id, text, g2 AS value, pos + instr(whole, g2) - 1 AS pos, {_type_duck('g1')} AS type, {2 + k} AS pass, pos AS rank FROM ({_matches_duck(rx, groups, 'marked')}) WHERE {where} AND NOT regexp_matches(g2, '^\\s*\\z')")
    by_type = detect.mask_by_type_sql("value", "type", config.strategy, known, dialect=DUCK)
    enabled = [d.type for d in reg.REGISTRY.enabled(types)]
    by_pattern = f"CASE WHEN regexp_matches(text, '<[^>]+>') THEN {detect.mask_by_type_sql('value', 'type', 'structural', enabled, dialect=DUCK)} ELSE {detect.mask_by_type_sql('value', 'type', config.strategy, enabled, dialect=DUCK)} END"
    step = "{'t': substring(a.t, 1, x.at) || x.mask || substring(a.t, x.at + x.n + 1), 'at': 0, 'n': 0, 'mask': ''}"
    return rf""",
    marked AS (SELECT * FROM texts WHERE regexp_matches(text, '^\s*[\[{{{{]|"[^"]+"\s*:') OR regexp_matches(text, '<[^>]+>')),
    fields AS (SELECT *, {by_type} AS mask FROM ({' UNION ALL '.join(fields)}) WHERE type NOT IN ({off})),
    proposed AS (SELECT src, id, text, value, pos, type, pass, rank, 0 AS priority, mask FROM fields
      UNION ALL SELECT src, id, text, value, pos, type, 5 AS pass, pos AS rank, priority, {by_pattern} AS mask FROM scored WHERE decided),
    claimed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, id, value ORDER BY pass, priority, rank) AS claim FROM proposed) WHERE claim = 1),
    apart AS (SELECT src, id, bool_or(pos < coalesce(before, 0)) AS has_overlap FROM (SELECT src, id, pos, lag(pos + length(value)) OVER (PARTITION BY src, id ORDER BY pos, pos + length(value)) AS before FROM claimed) GROUP BY src, id),
    scripts AS (SELECT src, id, count(*) AS n, list({{{{'t': '', 'at': pos, 'n': length(value), 'mask': mask}}}} ORDER BY (length(mask) = length(value)) DESC, pos DESC, pass, priority, rank) AS script FROM claimed GROUP BY src, id),
    masked AS (SELECT src, id, text, CASE WHEN script IS NULL THEN text ELSE list_reduce(list_prepend({{{{'t': text, 'at': 0, 'n': 0, 'mask': ''}}}}, script), lambda a, x: {step}).t END AS masked_text,
      coalesce(n, 0)::INT AS n, coalesce(has_overlap, false) AS has_overlap FROM texts LEFT JOIN scripts USING (src, id) LEFT JOIN apart USING (src, id))""".replace("{{", "{").replace("}}", "}")


DEFAULT = MaskingConfig(as_of=AS_OF)
CONFIGS = {
    "default": DEFAULT,
    "low_threshold": MaskingConfig(as_of=AS_OF, confidence_threshold=0.5, types={"ipAddress": True, "referenceNumber": True, "policyNumber": True, "transactionID": True, "routingNumber": True}),
    "strict_mode": MaskingConfig(as_of=AS_OF, mode="strict"),
    "manual_mode": MaskingConfig(as_of=AS_OF, mode="manual"),
    "inside_cdata": MaskingConfig(as_of=AS_OF, inside_cdata=True),
    "preset_default": MaskingConfig(as_of=AS_OF, preset="default"),
    "preset_privacy": MaskingConfig(as_of=AS_OF, preset="privacy", confidence_threshold=0.5),
}
_ROW = "src, id, type, value, pos, inside_name, birth, anomaly, structure, confidence, threshold, decided, first"


def _scored_query(config: MaskingConfig) -> tuple[Callable, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return detect.candidates(texts(spark, sf_dir), "text", config)

    return run, f"{scored_duck(config)} SELECT {_ROW} FROM ranked"


def _masked_query(config: MaskingConfig) -> tuple[Callable, str]:
    types = [d.type for d in reg.REGISTRY.enabled(config.effective_types())]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return detect.detect(texts(spark, sf_dir), "text", config)

    masked = f"CASE WHEN regexp_matches(text, '<[^>]+>') THEN {detect.mask_by_type_sql('value', 'type', 'structural', types, dialect=DUCK)} ELSE {detect.mask_by_type_sql('value', 'type', config.strategy, types, dialect=DUCK)} END"
    columns = f"type, value AS original_value, {masked} AS masked_value, pos, cast({line_sql('text', 'pos')} AS int) AS line, cast({column_sql('text', 'pos')} AS int) AS \"column\", confidence"
    return run, f"{scored_duck(config)} SELECT src, id, {columns} FROM ranked WHERE first"


def _masked_texts_query(strategy: str) -> tuple[Callable, str]:
    """Whole-text masking of documents, pages and lines."""
    from ..operators import mask_text

    config = MaskingConfig(as_of=AS_OF, strategy=strategy, confidence_threshold=0.5)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return mask_text.with_masked_text(texts(spark, sf_dir), "text", config).selectExpr("src", "id", "sha2(masked_text, 256) as digest", "size(detections) as n", "has_overlap")

    return run, f"{scored_duck(config)}{masked_duck(config)} SELECT src, id, sha256(masked_text) AS digest, n, has_overlap FROM masked"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told about the values masked in each text: below it, in the status bar, and as a notification."""
    from ..operators import mask_text

    found = mask_text.with_masked_text(texts(spark, sf_dir), "text", CONFIGS["low_threshold"])
    return found.selectExpr("src", "id", f"{mask_text.stats_line_sql()} as stats", f"{mask_text.notification_sql()} as notification", f"{mask_text.indicator_sql()} as indicator")


def _messages_sql() -> str:
    config = CONFIGS["low_threshold"]
    return f"""{scored_duck(config)}{masked_duck(config)},
    turns AS (SELECT src, id, type, row_number() OVER (PARTITION BY src, id ORDER BY pass, priority, rank) AS turn FROM claimed),
    kinds AS (SELECT src, id, type, count(*) AS n, min(turn) AS turn FROM turns GROUP BY ALL),
    told AS (SELECT src, id, sum(n) AS total, string_agg(n || ' ' || type || CASE WHEN n > 1 THEN 's' ELSE '' END, ', ' ORDER BY turn) AS what FROM kinds GROUP BY ALL)
    SELECT src, id, CASE WHEN what IS NULL THEN '' ELSE '// Data masked: ' || what END AS stats, 'Copied with ' || total || ' item' || CASE WHEN total > 1 THEN 's' ELSE '' END || ' masked: ' || what AS notification,
      CASE WHEN what IS NULL THEN 'Masking Active' ELSE total || ' masked' END AS indicator FROM texts LEFT JOIN told USING (src, id)"""


def _by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.counts_by_type(detect.detect(texts(spark, sf_dir), "text", CONFIGS["low_threshold"]), "src")


def _custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.mask_text import custom_matches

    pattern = CustomPattern("token", r'token = "[0-9a-f]{40}"', "[TOKEN]")
    return custom_matches(texts(spark, sf_dir), pattern)


def _all() -> dict[str, tuple[Callable, str | None]]:
    out: dict[str, tuple[Callable, str | None]] = {f"span_{d.type}": _span_query(d) for d in map(reg.REGISTRY.get, reg.REGISTRY.types())}
    out |= {f"detect_scored_{k}": _scored_query(c) for k, c in CONFIGS.items()}
    out["detect_masked_partial"] = _masked_query(CONFIGS["low_threshold"])
    for strategy in ("full", "structural", "hash", "redact"):
        out[f"detect_masked_{strategy}"] = _masked_query(MaskingConfig(as_of=AS_OF, confidence_threshold=0.5, strategy=strategy))
    out |= {f"mask_text_{s}": _masked_texts_query(s) for s in ("partial", "full", "structural", "hash", "redact")}
    out["mask_messages"] = _messages, _messages_sql()
    out["detections_by_type"] = _by_type, f"{scored_duck(CONFIGS['low_threshold'])} SELECT src, type, count(*) AS n FROM ranked WHERE first GROUP BY src, type"
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all().items() if s is not None}
