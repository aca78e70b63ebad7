
from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, Observation, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import hushtext as ht  # noqa: E402
import sql_oracle as sql  # noqa: E402
from hushtext import functions as hf  # noqa: E402
from hushtext.plans import fixed_values as fixed  # noqa: E402
from hushtext.sources.scratch import scratch_path  # noqa: E402
from hushtext.sources.tables import read_table  # noqa: E402
from hushtext.streaming import redact_stream  # noqa: E402

try:  # the driver may have taken these away
    import corpus_pipeline  # noqa: E402
    from hushtext.llm import queries as llm  # noqa: E402
except ImportError:
    corpus_pipeline = llm = None

SMOKE_DIR = "/root/testdata/sf0.001"

# --- inputs: the same SQL for both engines ------------------------------------

DOCUMENTS = "SELECT doc_id, lang, source, text FROM documents"
CONVERSATIONS = "SELECT conv_id, turn, role, text FROM conversations"
PAGES = "SELECT page_id, html AS text FROM pages"
BENCHMARK = "SELECT item_id, text FROM benchmark"

# clinical notes derived from orders; every rule finds something in them
NOTES = """SELECT o_orderkey AS note_id, concat(
 'Seen ', lpad(CAST(month(o_orderdate) AS STRING),2,'0'), '/',
 lpad(CAST(day(o_orderdate) AS STRING),2,'0'), '/',
 CAST(year(o_orderdate) AS STRING),
 ' and ', CAST(1 + o_orderkey % 9 AS STRING), ' days ago.{nl}',
 'MRN: A', lpad(CAST(o_custkey AS STRING),6,'0'), '; chart no ',
 lpad(CAST(o_orderkey AS STRING),8,'0'), '.{nl}',
 'Mail c', CAST(o_custkey AS STRING), '@clinic.example or c',
 CAST(o_custkey AS STRING), ' at clinic dot example.{nl}',
 'Call (555) ', lpad(CAST(o_custkey % 1000 AS STRING),3,'0'), '-',
 lpad(CAST(o_orderkey % 10000 AS STRING),4,'0'), ' ext. 7.{nl}',
 'SSN ', lpad(CAST(o_custkey % 1000 AS STRING),3,'0'), '-',
 lpad(CAST(o_orderkey % 100 AS STRING),2,'0'), '-',
 lpad(CAST(o_orderkey % 10000 AS STRING),4,'0'), '.{nl}',
 'Lives at ', CAST(1 + o_orderkey % 899 AS STRING), ' Elmwood Drive, Apt #',
 CAST(1 + o_orderkey % 40 AS STRING), 'B, zip ',
 lpad(CAST(o_orderkey % 100000 AS STRING),5,'0'), '.{nl}',
 CASE o_orderkey % 4 WHEN 0 THEN 'Dr. Harmon' WHEN 1 THEN 'Rev. Oakes'
 WHEN 2 THEN 'David Harmon' ELSE 'Mr. Nguyen' END, ', ',
 CASE o_orderkey % 3 WHEN 0 THEN 'Mercy Medical Center'
 WHEN 1 THEN 'St. Mary Clinic' ELSE 'the Dialysis Center' END,
 '; Ann Bolt, garcia, St Kilda Roadhouse.{nl}',
 'Known ', CASE o_orderkey % 3 WHEN 0 THEN 'sepsis' WHEN 1 THEN 'sep-sis'
 ELSE 'MRSA' END, ', seen last night and ', CASE o_orderkey % 3
 WHEN 0 THEN 'this morning' WHEN 1 THEN 'yesterday' ELSE 'Mar 3, 2021' END, '.{nl}',
 'At ', CAST(o_orderkey % 90 AS STRING), '.',
 lpad(CAST(o_custkey % 1000 AS STRING),3,'0'), ' N, ',
 CAST(o_orderkey % 180 AS STRING), '.25 W.{nl}',
 'Policy No ', lpad(CAST(o_custkey AS STRING),4,'0'), '-AB; license #D',
 lpad(CAST(o_custkey AS STRING),5,'0'), '; VIN 1HGCM826',
 lpad(CAST(o_orderkey AS STRING),8,'0'), 'A; pump S',
 lpad(CAST(o_custkey AS STRING),5,'0'), '.{nl}',
 'From 10.', CAST(o_orderkey % 256 AS STRING), '.0.',
 CAST(o_custkey % 256 AS STRING), ' see http://clinic.example/p/',
 CAST(o_orderkey AS STRING), ' .') AS text
FROM orders"""

# every text there is, for the single rules
ALL_TEXTS = f"""SELECT 'note' AS src, note_id AS a, 0 AS b, text FROM ({NOTES})
UNION ALL SELECT 'doc', doc_id, 0, text FROM documents
UNION ALL SELECT 'conv', conv_id, turn, text FROM conversations
UNION ALL SELECT 'page', page_id, 0, html FROM pages
UNION ALL SELECT 'item', item_id, 0, text FROM benchmark"""

_TABLES = ("documents", "conversations", "pages", "benchmark", "orders")


def _spark_text(query: str) -> str:
    return query.replace("{nl}", "\\n")


def _duck_text(query: str) -> str:
    return query.replace("{nl}", "'||chr(10)||'")


def _input(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    for name in _TABLES:
        if name in query:
            read_table(spark, f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(_spark_text(query))


# --- query builders -----------------------------------------------------------


def _rule(rule_id: str):
    def run(spark, sf_dir):
        texts = _input(spark, sf_dir, ALL_TEXTS)
        return ht.redact_rule(texts, "text", rule_id).drop("text")

    query = (
        sql.chain(_duck_text(ALL_TEXTS), ["src", "a", "b"], [rule_id], tidied=False)
        + f" SELECT src, a, b, redacted, n_{rule_id} AS n FROM redacted_rows"
    )
    return run, query


def _flat(df: DataFrame) -> DataFrame:
    return df.select("*", "redaction_counts.*").drop("redaction_counts", "text")


def _redact(source: str, keys: list[str], safe_harbor=False, skip=(), **config):
    def run(spark, sf_dir):
        return _flat(
            ht.redact(
                _input(spark, sf_dir, source),
                safe_harbor=safe_harbor,
                skip=skip,
                config=config,
            )
        )

    return run, _redact_sql(source, keys, safe_harbor, skip, config)


def _names_table():
    """Documents without names from a table: the passages of the benchmark, whole."""

    def run(spark, sf_dir):
        passages = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
        # also where they are few, the terms stay on the cluster
        options = ht.Options(names=passages, literal_chars=0)
        texts = _input(spark, sf_dir, DOCUMENTS)
        return _flat(ht.redact(texts, skip=_FEW, config=options))

    names = sql.names_of("text", "benchmark")
    return run, _redact_sql(DOCUMENTS, _DOC, skip=_FEW, config={"names": names})


def _redact_sql(source, keys, safe_harbor=False, skip=(), config=None):
    options = {
        {"mrn_min_length": "low", "mrn_max_length": "high"}.get(name, name): value
        for name, value in (config or {}).items()
    }
    sums = sql.counts(safe_harbor=safe_harbor, skip=skip)
    columns = [*keys, "redacted"]
    columns += [f"{expr} AS {field}" for field, expr in sums.items()]
    columns.append(" + ".join(sums.values()) + " AS redactions_total")
    with_ = sql.chain(
        _duck_text(source), keys, safe_harbor=safe_harbor, skip=skip, **options
    )
    return f"{with_} SELECT {', '.join(columns)} FROM redacted_rows"


def _summary(source: str, keys: list[str], by: list[str], safe_harbor=True):
    def run(spark, sf_dir):
        texts = _input(spark, sf_dir, source)
        return ht.redaction_summary(ht.redact(texts, safe_harbor=safe_harbor, text=False), by)

    inner = _redact_sql(source, keys, safe_harbor)
    columns = [*by, 'count(*) AS "rows"']
    columns.append("count(*) FILTER (redactions_total > 0) AS rows_redacted")
    for field in (*fixed.COUNT_FIELDS, "redactions_total"):
        columns.append(f"CAST(coalesce(sum({field}), 0) AS BIGINT) AS {field}")
    group = f" GROUP BY {', '.join(by)}" if by else ""
    return run, f"SELECT {', '.join(columns)} FROM ({inner}){group}"


def _text_function(source: str, derived: str, function, oracle):
    """A column function over a text derived from a table by the same SQL."""
    query = f"SELECT * REPLACE ({derived} AS text) FROM ({source})"

    def run(spark, sf_dir):
        texts = _input(spark, sf_dir, source)
        return texts.withColumn("text", F.expr(derived)).withColumn(
            "text", function("text")
        )

    return run, f"SELECT * REPLACE ({oracle('text')} AS text) FROM ({query})"


def _translate(fold: str):
    variants = fixed.SYMBOL_FOLDS[fold]
    plain = sql.text(fold * len(variants))
    return lambda expr: f"translate({expr}, {sql.text(variants)}, {plain})"


def _dictionary():
    """The default facility terms and the source names of the documents."""

    def run(spark, sf_dir):
        sources = read_table(spark, f"{sf_dir}/documents.parquet").select("source")
        return ht.build_dictionary(fixed.FACILITY_TERMS, sources)

    values = ", ".join(f"({sql.text(t)})" for t in fixed.FACILITY_TERMS)
    query = (
        "SELECT row_number() OVER (ORDER BY term) AS ord, term FROM ("
        f"SELECT col0 AS term FROM (VALUES {values}) UNION "
        "SELECT trim(source) FROM documents WHERE trim(source) <> '')"
    )
    return run, query


def _counts_only(source: str, keys: list[str], column: str):
    """Rows with the counters as JSON, or with their sum."""

    def run(spark, sf_dir):
        rows = ht.redact(_input(spark, sf_dir, source), safe_harbor=True)
        value = ht.counts_json() if column == "stats" else ht.counts_total()
        return rows.select(*keys, value.alias(column))

    inner = _redact_sql(source, keys, True)
    if column == "stats":
        lines = [
            f"'  \"{field}\" : ' || CAST({field} AS VARCHAR)"
            for field in fixed.COUNT_FIELDS
        ]
        value = "'{' || chr(10) || "
        value += " || ',' || chr(10) || ".join(lines) + " || chr(10) || '}'"
    else:
        value = " + ".join(fixed.COUNT_FIELDS)
    return run, f"SELECT {', '.join(keys)}, {value} AS {column} FROM ({inner})"


def _report(source: str, keys: list[str]):
    def run(spark, sf_dir):
        rows = ht.redact(_input(spark, sf_dir, source), safe_harbor=True, text=False)
        return ht.redaction_report(rows)

    return run, _report_sql(source, keys)


def _report_sql(source: str, keys: list[str]) -> str:
    lines = [("total", "redactions_total")]
    lines += [(label, field) for field, label in fixed.REPORT_LABELS.items()]
    inner = _redact_sql(source, keys, True)
    selects = [
        f"SELECT {i} AS ord, {sql.text(label)} AS category, "
        f"CAST(coalesce(sum({field}), 0) AS BIGINT) AS n FROM done"
        for i, (label, field) in enumerate(lines)
    ]
    return (
        f"WITH done AS MATERIALIZED ({inner}) SELECT * FROM ("
        + " UNION ALL ".join(selects)
        + ") WHERE n > 0 OR ord = 0"
    )


def _observed(source: str, keys: list[str]):
    """Totals that come for free with a write of the redacted rows."""

    def run(spark, sf_dir):
        seen = Observation("redactions")
        rows = ht.redact(_input(spark, sf_dir, source), safe_harbor=True)
        ht.observe_redactions(rows, seen).write.format("noop").mode("overwrite").save()
        totals = seen.get
        names = ["rows", *fixed.COUNT_FIELDS, "redactions_total"]
        schema = ", ".join(f"`{name}` long" for name in names)
        return spark.createDataFrame([tuple(totals[n] for n in names)], schema)

    columns = ['count(*) AS "rows"'] + [
        f"CAST(coalesce(sum({f}), 0) AS BIGINT) AS {f}"
        for f in (*fixed.COUNT_FIELDS, "redactions_total")
    ]
    inner = _redact_sql(source, keys, True)
    return run, f"SELECT {', '.join(columns)} FROM ({inner})"


def _written(source: str, keys: list[str]):
    """Redact, write as a table, read back."""

    def run(spark, sf_dir):
        path = scratch_path(spark, "redacted")
        ht.write_redacted(ht.redact(_input(spark, sf_dir, source)), path)
        return _flat(spark.read.parquet(path))

    return run, _redact_sql(source, keys)


def _streamed(keys: list[str]):
    """Documents redacted as a stream, then read back."""

    def run(spark, sf_dir):
        schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
        # a pattern, as a stream takes it for one file and for a folder of files alike
        stream = (
            spark.readStream.schema(schema)
            .parquet(f"{sf_dir}/{{documents.parquet}}")
            .select("doc_id", "lang", "source", "text")
        )
        path = scratch_path(spark, "streamed")
        redact_stream(
            stream, path, scratch_path(spark, "progress"), available_now=True
        ).awaitTermination()
        return _flat(spark.read.parquet(path))

    return run, _redact_sql(DOCUMENTS, keys)


_DOC = ["doc_id", "lang", "source"]
_CONV = ["conv_id", "turn", "role"]
_EVERY = list(fixed.TOKENS)
_FEW = ("phone", "date", "mrn", "address", "facility", "zip")
_LOOSE = "replace(replace(text, '. ', '.\t  '), 'e', ' \x0be')"


def _registry() -> dict[str, tuple[Callable, str | None]]:
    found = {rule_id: _rule(rule_id) for rule_id in ht.RULE_IDS}
    found |= {
        # full-width A, circled 1, ohm sign and the ligature fi stand for vowels
        "norm_nfkc": _text_function(
            DOCUMENTS,
            "translate(text, 'aeou', 'Ａ①Ωﬁ')",
            hf.nfkc,
            lambda e: f"replace(translate({e}, 'Ａ①Ω', 'A1Ω'), 'ﬁ', 'fi')",
        ),
        "norm_apostrophe": _text_function(
            PAGES,
            "translate(text, 'aeou', '‘’‛′')",
            lambda c: hf.fold_symbols(c, "'"),
            _translate("'"),
        ),
        "norm_quote": _text_function(
            PAGES,
            "translate(text, '\"ae', '“”″')",
            lambda c: hf.fold_symbols(c, '"'),
            _translate('"'),
        ),
        "norm_dash": _text_function(
            PAGES,
            "translate(text, '-ae', '–—−')",
            lambda c: hf.fold_symbols(c, "-"),
            _translate("-"),
        ),
        "norm_bullet": _text_function(
            PAGES,
            "translate(text, '*#%$a', '•·‧⁃・')",
            lambda c: hf.fold_symbols(c, " "),
            _translate(" "),
        ),
        "norm_space": _text_function(
            DOCUMENTS,
            _LOOSE,
            hf.squeeze_spaces,
            lambda e: sql.swap(e, f"[{sql.ODD_SPACES}]+", " "),
        ),
        "normalize_text": _text_function(
            DOCUMENTS,
            "translate(replace(text, ' ', '\t '), 'aeiou', '’”—• ')",
            hf.normalize_text,
            sql.normalize,
        ),
        "tidy_space_punct": _text_function(
            DOCUMENTS,
            "replace(text, '.', ' \n .')",
            hf.strip_space_before_punctuation,
            lambda e: sql.swap(e, rf"[{sql.SPACES}]+([.,;:!?])", r"\1"),
        ),
        "tidy_dup_punct": _text_function(
            DOCUMENTS,
            "replace(replace(text, '.', '?.!'), ',', ',,')",
            hf.squeeze_punctuation,
            lambda e: sql.swap(e, r"[.,;:!?]+([.,;:!?])", r"\1"),
        ),
        "tidy_trim": _text_function(
            CONVERSATIONS,
            "concat('　\n', text, '  \x85')",
            hf.trim_whitespace,
            sql.trim,
        ),
        "tidy_text": _text_function(
            CONVERSATIONS,
            "concat(' ', replace(text, 'e', ' \n.;'), '\n')",
            hf.tidy_text,
            sql.tidy,
        ),
        "dict_union": _dictionary(),
        "redact_documents": _redact(DOCUMENTS, _DOC),
        "redact_conversations": _redact(CONVERSATIONS, _CONV, safe_harbor=True),
        "redact_pages": _redact(PAGES, ["page_id"], safe_harbor=True),
        "redact_benchmark": _redact(BENCHMARK, ["item_id"], safe_harbor=True),
        "redact_notes": _redact(NOTES, ["note_id"]),
        "opt_safe_harbor": _redact(NOTES, ["note_id"], safe_harbor=True),
        "opt_safe_harbor_documents": _redact(DOCUMENTS, _DOC, safe_harbor=True),
        "opt_skip": _redact(
            NOTES, ["note_id"], True, ("person", "email", "mrn", "address", "url")
        ),
        "opt_skip_all": _redact(DOCUMENTS, _DOC, True, _EVERY),
        "opt_mrn_range": _redact(
            NOTES, ["note_id"], mrn_min_length=2, mrn_max_length=4
        ),
        "opt_extra_names": _redact(
            NOTES,
            ["note_id"],
            names=[
                "Elmwood", "  Ann ", "Ann Bolt", "roadhouse", "", "sepsis", "sep-sis",
                "mrsa",
            ],
        ),
        "opt_extra_names_table": _names_table(),
        "opt_extra_keywords": _redact(
            NOTES, ["note_id"], keywords=["Mercy Medical", "Kilda Roadhouse"]
        ),
        "dict_pattern": _redact(
            DOCUMENTS,
            _DOC,
            names=["the", "des", "que la", "ünd", "éa"],
            keywords=["of the", "l'un"],
        ),
        "counts_total": _counts_only(NOTES, ["note_id"], "total"),
        "counts_json": _counts_only(CONVERSATIONS, _CONV, "stats"),
        "corpus_summary": _summary(NOTES, ["note_id"], []),
        "corpus_summary_by_lang": _summary(DOCUMENTS, _DOC, ["lang"]),
        "corpus_summary_by_lang_source": _summary(DOCUMENTS, _DOC, ["lang", "source"]),
        "corpus_summary_by_role": _summary(CONVERSATIONS, _CONV, ["role"]),
        "report_lines": _report(NOTES, ["note_id"]),
        "report_lines_documents": _report(DOCUMENTS, _DOC),
        "report_channel": _observed(NOTES, ["note_id"]),
        "sink_table": _written(CONVERSATIONS, _CONV),
        "redact_stream": _streamed(_DOC),
    }
    return found


def entry(spark: SparkSession) -> DataFrame:
    """Redactions per language and source over the documents."""
    return _registry()["corpus_summary_by_lang_source"][0](spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: run for name, (run, _) in _registry().items()}
    if llm:
        found |= llm.QUERIES | {"pipeline": corpus_pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    found = {name: query for name, (_, query) in _registry().items() if query}
    if llm:
        found |= llm.ORACLE_SQL
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
