"""Labels, text and naming functions."""

from pyspark.sql import functions as F

from answerloom import fixed_values as fv
from answerloom.catalog import views as v
from answerloom.functions import labels as lb, naming as nm, text as tx
from answerloom.functions.basics import blank_if_null, case_map
from answerloom.operators import generation as gn, leaderboard as ld, quiz as qz, scoring as sc

QUERIES = {}

QUERIES["P1_rename_constant_topic_reorder"] = (
    lambda s, d: v.table(s, d, "orders")
    .withColumnsRenamed({"o_orderkey": "task_id", "o_orderpriority": "labels"})
    .withColumn("topic", F.lit(fv.FIVE_WAY_TOPIC))
    .select("task_id", "topic", "labels"),
    "SELECT o_orderkey AS task_id, 'scientsbank' AS topic, o_orderpriority AS labels FROM orders",
)

# Labels as numbers, decimals and names in mixed case with white space around.
_RAW_STRICT = {
    "1-URGENT": ("  INCORRECT\t", 0), "2-HIGH": ("partial ", 1), "3-MEDIUM": ("2", 2),
    "4-NOT SPECIFIED": (" 1.0", 1), "5-LOW": ("Correct", 2),
}


def raw_labels(spark, folder, raws):
    return v.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        case_map(F.col("o_orderpriority"), raws).alias("labels"),
    )


def _cases(column, mapping):
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in mapping.items()) + " END"


QUERIES["P2a_strict_label"] = (
    lambda s, d: raw_labels(s, d, {k: raw for k, (raw, _) in _RAW_STRICT.items()}).select(
        "row_id", lb.strict_label(F.col("labels")).alias("y_true")
    ),
    "SELECT o_orderkey AS row_id, "
    + _cases("o_orderpriority", {k: code for k, (_, code) in _RAW_STRICT.items()})
    + " AS y_true FROM orders",
)

_RAW_LENIENT = {
    "1-URGENT": "  Incorrect", "2-HIGH": "PARTIAL", "3-MEDIUM": " partially correct ",
    "4-NOT SPECIFIED": "2", "5-LOW": "correct",
}

QUERIES["P2b_lenient_label"] = (
    lambda s, d: raw_labels(s, d, _RAW_LENIENT).select(
        "row_id",
        lb.lenient_label(F.col("labels")).alias("unknown_null"),
        lb.lenient_label(F.col("labels"), -1).alias("unknown_batch"),
        lb.lenient_label(F.col("labels"), 0).alias("unknown_single"),
    ),
    "SELECT o_orderkey AS row_id, x AS unknown_null, coalesce(x, -1) AS unknown_batch, "
    "coalesce(x, 0) AS unknown_single FROM (SELECT o_orderkey, "
    + _cases("o_orderpriority", {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 1, "5-LOW": 2})
    + " AS x FROM orders)",
)

QUERIES["P2b_numeric_label_truncated"] = (
    lambda s, d: v.table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        lb.lenient_label(F.col("l_tax") * 30, numeric=True).alias("y_true"),
    ),
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
              CAST(trunc(l_tax * 30) AS INTEGER) AS y_true FROM lineitem""",
)

FIVE_WAY = {
    "1-URGENT": "correct", "2-HIGH": "partially_correct_incomplete", "3-MEDIUM": "contradictory",
    "4-NOT SPECIFIED": "irrelevant", "5-LOW": "non_domain",
}

QUERIES["P3_five_way_to_three_way"] = (
    lambda s, d: raw_labels(s, d, FIVE_WAY).select(
        "row_id", lb.collapse_five_way(F.col("labels")).alias("labels")
    ),
    """SELECT o_orderkey AS row_id, CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1
              ELSE 0 END AS labels FROM orders""",
)

QUERIES["P4_points_to_label"] = (
    lambda s, d: v.subtask_points(s, d).select(
        "participant", "letter", lb.points_label(F.col("points")).alias("labels")
    ),
    "WITH " + v.SUBTASK_POINTS
    + " SELECT participant, letter, CAST(points * 2 AS INTEGER) AS labels FROM subtask_points",
)

QUERIES["P5_topic_of_task"] = (
    lambda s, d: v.table(s, d, "lineitem")
    .select(
        F.concat(
            F.when(F.col("l_linestatus") == "F", "sentences_").otherwise("validity_and_soundness_"),
            F.substr(F.lit(v.LETTERS), "l_linenumber", F.lit(1)),
        ).alias("task")
    )
    .groupBy("task", lb.topic_of_task(F.col("task")).alias("topic"))
    .agg(F.count("*").alias("n")),
    """SELECT CASE l_linestatus WHEN 'F' THEN 'sentences_' ELSE 'validity_and_soundness_' END
              || substr('abcdefgh', l_linenumber, 1) AS task,
              CASE l_linestatus WHEN 'F' THEN 'sentences' ELSE 'validity' END AS topic, count(*) AS n
       FROM lineitem GROUP BY ALL""",
)

QUERIES["P6_decimal_comma"] = (
    lambda s, d: v.table(s, d, "events").select(
        "event_id",
        tx.decimal_comma(
            F.when(F.col("event_type") == "error", "n/a").otherwise(
                F.concat(F.floor("value").cast("string"), F.lit(",5"))
            )
        ).alias("points"),
    ),
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN floor(value) + 0.5 END AS points
       FROM events""",
)

QUERIES["P7_prompt_with_reference"] = (
    lambda s, d: v.pairs(s, d).select(
        "row_id",
        tx.prompt(F.col("question"), F.col("student_answer"), F.col("reference_answer")).alias("prompt"),
    ),
    "WITH " + v.PAIRS + """
    SELECT row_id, 'Question: ' || question || chr(10) || 'Answer: ' || student_answer
      || coalesce(chr(10) || 'Reference answer: ' || reference_answer, '') AS prompt FROM pairs""",
)

QUERIES["P7_prompt_of_documents_without_reference"] = (
    lambda s, d: v.table(s, d, "documents").select(
        "doc_id", F.md5(tx.prompt(F.col("source"), F.col("text"))).alias("prompt_md5")
    ),
    """SELECT doc_id, md5('Question: ' || coalesce(source, '') || chr(10) || 'Answer: '
              || coalesce(text, '')) AS prompt_md5 FROM documents""",
)

# Lines of a turn as answer options; the first line with a comma is correct.
QUERIES["P8_reference_answer_of_options"] = (
    lambda s, d: v.table(s, d, "conversations").select(
        "conv_id", "turn",
        tx.reference_option(
            F.when(
                F.col("role") != "system",
                F.transform(
                    F.split("text", "\n"),
                    lambda line: F.struct(
                        line.alias("answer"), F.contains(line, F.lit(",")).alias("is_correct")
                    ),
                ),
            )
        ).alias("reference_answer"),
    ),
    """SELECT conv_id, turn, CASE WHEN role = 'system' THEN '' ELSE
         coalesce(list_filter(string_split(text, chr(10)), lambda l: contains(l, ','))[1],
                  string_split(text, chr(10))[1]) END AS reference_answer
       FROM conversations""",
)

SPANS_SQL = """regexp_replace(regexp_replace(regexp_replace({0},
  '<span style="[^"]*background-color:rgb\\(\\d{{1,3}},\\d{{1,3}},\\d{{1,3}}\\);?[^"]*">', '', 'g'),
  '<span style="?background-color:transparent;color:#000000;"?>', '', 'g'),
  '<span style="?color:rgb\\(0,0,0\\);"?>', '', 'g')"""

QUERIES["P9a_drop_styled_spans"] = (
    lambda s, d: v.styled_pages(s, d).select("page_id", tx.drop_styled_spans(F.col("html")).alias("html")),
    "WITH " + v.STYLED + f" SELECT page_id, {SPANS_SQL.format('html')} AS html FROM styled",
)

UNIFIED_SQL = (
    f"replace(replace(replace({SPANS_SQL.format('html')}, '<!--HTML-->', ''), '</p><p>', '<br />'), "
    "'<br /><br />', '<br />')"
)

QUERIES["P9b_clean_html"] = (
    lambda s, d: v.styled_pages(s, d).select("page_id", tx.clean_html(F.col("html")).alias("html")),
    "WITH " + v.STYLED + f" SELECT page_id, replace({UNIFIED_SQL}, '</span>', '') AS html FROM styled",
)

QUERIES["P9b_unify_breaks"] = (
    lambda s, d: v.styled_pages(s, d).select("page_id", tx.unify_breaks(F.col("html")).alias("html")),
    "WITH " + v.STYLED + f" SELECT page_id, {UNIFIED_SQL} AS html FROM styled",
)

# The pages hold four entities; '&' is escaped once more, so decoding takes two rounds.
QUERIES["P10_decode_entities"] = (
    lambda s, d: v.table(s, d, "pages").select(
        "page_id",
        tx.clean_remark(F.replace("html", F.lit("&"), F.lit("&amp;"))).alias("html"),
    ),
    """SELECT page_id, replace(replace(replace(replace(replace(replace(html,
         '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '&amp', '&'),
         '</p><p>', '<br />') AS html FROM pages""",
)

# Marks every letter-dot that stands free, then reads between the marks. Two
# passes, since neighbouring matches share a character.
_MARK = "regexp_replace({0}, '(^|[^\\p{{L}}\\p{{N}}_])([a-hA-H])\\.', '\\1' || chr(1) || '\\2.', 'g')"
_TRAILING = (
    "trim(regexp_replace(regexp_replace(trim({0}, chr(9)||chr(10)||chr(13)||' '), "
    "'\\s*</?p>\\s*$', ''), '\\s*<br\\s*/?>\\s*$', ''), chr(9)||chr(10)||chr(13)||' ')"
)


def _loose(letter):
    # From the first 'x.' on, marked or not, up to the next mark.
    found = (
        f"regexp_extract(marked, '(?is){letter}\\.\\s*([^\\x01]*)', 1)"
    )
    return _TRAILING.format(found)



def _sections(spark, folder):
    """Enumerated turns as the text of both quiz sections."""
    return v.enumerated(spark, folder).select(
        "conv_id", "turn", *[F.col("quiz_text").alias(section) for section in fv.QUIZ_LETTERS]
    )


QUERIES["P11_extract_subtask_loose"] = (
    lambda s, d: qz.subtask_columns(_sections(s, d)).drop(*fv.QUIZ_LETTERS),
    "WITH " + v.ENUMERATED + ", m AS (SELECT conv_id, turn, "
    + _MARK.format(_MARK.format("quiz_text")) + " AS marked FROM enumerated) SELECT conv_id, turn, "
    + ", ".join(
        f"{_loose(x)} AS {section}_{x}" for section, ls in fv.QUIZ_LETTERS.items() for x in ls
    ) + " FROM m",
)

FLAT_SQL = (
    "trim(regexp_replace(regexp_replace(replace({0}, '</span>', ''), '<br\\s*/?>', ' ', 'g'), "
    "'\\s+', ' ', 'g'))"
)


def strict_sql(letter, letters):
    start = f"(?is)(?:^|[^\\p{{L}}\\p{{N}}_]){letter}\\.\\s*(.*)"
    rest = f"regexp_extract(quiz_text, '{start}', 1)"
    place = letters.index(letter)
    if place + 1 < len(letters):
        stop = letters[place + 1]
        # The character before the stop belongs to the answer; white space is trimmed anyway.
        found = (
            f"regexp_replace({rest}, '(?is)^(.*?(?:^|[^\\p{{L}}\\p{{N}}_])){stop}\\."
            "(?:[^\\p{L}\\p{N}_].*|)$', '\\1')"
        )
    else:
        found = rest
    return FLAT_SQL.format(_TRAILING.format(found))


SENTENCES = fv.QUIZ_LETTERS["sentences"]
VALIDITY = fv.QUIZ_LETTERS["validity_and_soundness"]

QUERIES["P12_extract_subtask"] = (
    lambda s, d: qz.strict_subtask_columns(_sections(s, d)).drop(*fv.QUIZ_LETTERS),
    "WITH " + v.ENUMERATED + " SELECT conv_id, turn, "
    + ", ".join(f"{strict_sql(x, SENTENCES)} AS sentences_{x}" for x in SENTENCES) + ", "
    + ", ".join(f"{strict_sql(x, VALIDITY)} AS validity_and_soundness_{x}" for x in VALIDITY) + " FROM enumerated",
)

QUERIES["P13_strip_boilerplate"] = (
    lambda s, d: v.enumerated(s, d).select(
        "conv_id", "turn",
        tx.strip_boilerplate(
            F.concat(F.lit("true/FALSE,  because ... <br/>Yes/No, because ...<br />"), "quiz_text", F.lit("</span>"))
        ).alias("answer"),
    ),
    "WITH " + v.ENUMERATED + " SELECT conv_id, turn, " + FLAT_SQL.format(
        "regexp_replace(regexp_replace('true/FALSE,  because ... <br/>Yes/No, because ...<br />' "
        "|| quiz_text || '</span>', 'True/False,\\s*because\\s*\\.\\.\\.\\s*<br\\s*/?>', '', 'gi'), "
        "'Yes/No,\\s*because\\s*\\.\\.\\.\\s*<br\\s*/?>', '', 'gi')"
    ) + " AS answer FROM enumerated",
)

QUERIES["P14_model_and_dataset_names"] = (
    lambda s, d: v.table(s, d, "part").select(
        "p_partkey",
        nm.short_model_name(F.concat_ws("/", "p_brand", "p_type", "p_name")).alias("model"),
        nm.dataset_name(F.concat(F.lit("data/"), "p_brand", F.lit("/"), "p_name", F.lit(".csv"))).alias("by_folder"),
        nm.dataset_name(F.concat(F.lit("data/"), "p_type", F.lit(".csv"))).alias("by_file"),
        nm.dataset_name(F.concat(F.lit("/srv/data/"), "p_name", F.lit(".v2.csv"))).alias("by_stem"),
        nm.dataset_name(F.col("p_name"), F.col("p_type")).alias("explicit"),
    ),
    """SELECT p_partkey, p_name AS model, p_brand AS by_folder, p_type AS by_file,
              p_name || '.v2' AS by_stem, p_type AS explicit FROM part""",
)

QUERIES["P14_stem_of_urls"] = (
    lambda s, d: v.table(s, d, "pages").select(
        "page_id", nm.dataset_name(F.concat(F.lit("/"), "url")).alias("dataset")
    ),
    """SELECT page_id, CASE WHEN strpos(ltrim(last, '.'), '.') > 0 AND last NOT LIKE '%.'
              THEN regexp_replace(last, '\\.[^.]+$', '') ELSE last END AS dataset
       FROM (SELECT page_id, regexp_extract(url, '([^/]+)/*$', 1) AS last FROM pages)""",
)


def _dirty(spark, folder):
    value = F.col("value").cast("string")
    return v.table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_type") == "view", F.concat(F.lit('"'), value, F.lit('"')))
        .when(F.col("event_type") == "click", F.concat(F.lit("'"), value))
        .when(F.col("event_type") == "purchase", F.concat(F.lit(" \"'"), value, F.lit("\"\t")))
        .when(F.col("event_type") == "signup", F.concat(value, F.lit('"')))
        .otherwise(value)
        .alias("kappa"),
    )


QUERIES["P16_clean_dirty_numbers"] = (
    lambda s, d: _dirty(s, d).select("event_id", tx.dirty_number(F.col("kappa")).alias("kappa")),
    """SELECT event_id, CASE WHEN event_type <> 'signup' THEN value END AS kappa FROM events""",
)

QUERIES["P17_min_max_normalise"] = (
    lambda s, d: ld.normalize(
        v.table(s, d, "orders")
        .withColumn("constant", F.lit(8.0)),
        ["o_totalprice", "constant"],
    ).select(
        "o_orderkey", F.round("o_totalprice_norm", 9).alias("price_norm"),
        F.col("constant_norm"),
    ),
    """SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER ())
         / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 9) AS price_norm,
         0.5::DOUBLE AS constant_norm FROM orders""",
)

QUERIES["P19_model_names_and_order"] = (
    lambda s, d: ld.model_leaderboard(v.runs(s, d), "run", "metric").select(
        "model_group", "model_display", "display_order",
        F.round("mean_kappa", 7).alias("mean_kappa"), F.round("std_kappa", 7).alias("std_kappa"),
    ),
    "WITH " + v.RUNS + """, g AS (
      SELECT CASE WHEN run LIKE 'gpt-4o%' THEN 'openai/chatgpt-4o'
               WHEN run = 'lora_gpt2-large' THEN 'openai-community/gpt2-large'
               WHEN run = 'lora_flan-t5-large' THEN 'google/flan-t5-large'
               WHEN run = 'lora_Qwen3-0.6B' THEN 'qwen/qwen3-0.6b' ELSE run END AS model_group, metric
      FROM runs)
    SELECT model_group,
           CASE model_group WHEN 'openai/chatgpt-4o' THEN 'GPT-4o'
             WHEN 'openai-community/gpt2-large' THEN 'GPT-2 Large'
             WHEN 'google/flan-t5-large' THEN 'Flan-T5 Large' WHEN 'qwen/qwen3-0.6b' THEN 'Qwen3 0.6B'
             ELSE 'Mistralai Mixed-7B' END AS model_display,
           CASE model_group WHEN 'openai/chatgpt-4o' THEN 1 WHEN 'google/flan-t5-large' THEN 3
             WHEN 'openai-community/gpt2-large' THEN 4 WHEN 'qwen/qwen3-0.6b' THEN 5
             ELSE 999 END AS display_order,
           round(avg(metric), 7) AS mean_kappa, round(stddev_samp(metric), 7) AS std_kappa
    FROM g GROUP BY ALL""",
)

QUERIES["P19_display_names_of_documents"] = (
    lambda s, d: v.table(s, d, "part").select(
        "p_partkey", nm.model_display(F.concat_ws("/", "p_name", "p_brand")).alias("display")
    ),
    """SELECT p_partkey, array_to_string(list_transform(
         regexp_extract_all(replace(p_name || '/' || p_brand, '/', ' '), '(\\p{L}+|[^\\p{L}]+)'),
         lambda w: upper(w[1]) || lower(w[2:])), '') AS display FROM part""",
)

QUERIES["P20_defaults_for_missing"] = (
    lambda s, d: v.pairs(s, d).select(
        "row_id",
        blank_if_null(F.col("reference_answer")).alias("reference_answer"),
        F.coalesce(F.length("reference_answer").cast("double"), F.lit(0.0)).alias("points_checked"),
        F.coalesce(F.length("reference_answer").cast("double"), F.lit(-1.0)).alias("points_long"),
    ),
    "WITH " + v.PAIRS + """
    SELECT row_id, coalesce(reference_answer, '') AS reference_answer,
           coalesce(CAST(length(reference_answer) AS DOUBLE), 0) AS points_checked,
           coalesce(CAST(length(reference_answer) AS DOUBLE), -1) AS points_long FROM pairs""",
)

QUERIES["P21_reference_visible_by_label"] = (
    lambda s, d: gn.requests(
        v.pairs(s, d).withColumn("task_id", F.col("row_id")),
        {"correct": 2, "partial": 1, "incorrect": 1},
    ).select("task_id", "label", "i", "reference_answer"),
    "WITH " + v.PAIRS + """
    SELECT row_id AS task_id, label, i,
           CASE WHEN label <> 'incorrect' THEN reference_answer END AS reference_answer
    FROM pairs, (VALUES ('correct', 1), ('correct', 2), ('partial', 1), ('incorrect', 1)) AS q(label, i)""",
)

QUERIES["P22_fallback_answers"] = (
    lambda s, d: gn.requests(
        v.pairs(s, d).withColumn("task_id", F.col("row_id")),
        {"correct": 1, "partial": 1, "incorrect": 1},
        pass_reference={"incorrect": True},
    ).select(
        "task_id", "label",
        gn.with_fallback(
            F.when(F.col("task_id").endswith("-2"), F.lower("question")),
            F.col("label"), F.col("reference_answer"), F.col("i"), F.col("task_id"),
        ).alias("answer"),
    ),
    "WITH " + v.PAIRS + """
    SELECT row_id AS task_id, label,
           CASE WHEN row_id LIKE '%-2' THEN lower(question)
             WHEN label = 'correct' THEN reference_answer
             WHEN label = 'partial' THEN 'Partial answer 1 for question ' || row_id
             ELSE 'Incorrect answer 1 for question ' || row_id END AS answer
    FROM pairs, (VALUES ('correct'), ('partial'), ('incorrect')) AS q(label)""",
)

QUERIES["P23_generated_names"] = (
    lambda s, d: v.table(s, d, "part").select(
        "p_partkey",
        nm.evaluation_run_name(
            F.concat_ws("/", "p_type", "p_brand"), F.lit("single"), F.col("p_size"), F.col("p_size")
        ).alias("run_name"),
        nm.generated_file_name(
            F.lit(3), F.col("p_size"), F.lit(1), F.col("p_brand"), F.lit("per_question")
        ).alias("file_name"),
        nm.grid_run_name(F.lit(0.0005), F.col("p_size"), F.col("p_size") * 2.0, F.lit(0.2), F.lit(16)).alias("grid_name"),
        nm.adapter_run_name(F.concat_ws("/", "p_type", "p_brand"), F.concat_ws("/", "p_type", "p_name")).alias("adapter_name"),
    ),
    """SELECT p_partkey,
         p_brand || '_single' || CASE WHEN p_size > 1 THEN '_run' || p_size ELSE '' END AS run_name,
         'student_answers_c3_p' || p_size || '_i1_' || p_brand || '_per_question.csv' AS file_name,
         'lr_0.0005_r_' || p_size || '_alpha_' || (p_size * 2) || '.0_drop_0.2_bs_16' AS grid_name,
         'eval_' || p_brand || '_' || p_name AS adapter_name
       FROM part""",
)

QUERIES["M1_row_map"] = (
    lambda s, d: v.table(s, d, "documents").select(
        "doc_id", tx.strip_boilerplate(F.replace("text", F.lit("\n"), F.lit("<br>"))).alias("text")
    ),
    "SELECT doc_id, " + FLAT_SQL.format(
        "regexp_replace(regexp_replace(replace(text, chr(10), '<br>'), "
        "'True/False,\\s*because\\s*\\.\\.\\.\\s*<br\\s*/?>', '', 'gi'), "
        "'Yes/No,\\s*because\\s*\\.\\.\\.\\s*<br\\s*/?>', '', 'gi')"
    ) + " AS text FROM documents",
)

QUERIES["M2_model_inputs"] = (
    lambda s, d: sc.model_inputs(
        v.pairs(s, d).withColumn("labels", F.lit(1)).withColumn("topic", F.col("task_id")),
        include_reference=True,
    ),
    "WITH " + v.PAIRS + """
    SELECT 1 AS labels, task_id AS topic, 'Question: ' || question || chr(10) || 'Answer: '
      || student_answer || coalesce(chr(10) || 'Reference answer: ' || reference_answer, '') AS text
    FROM pairs""",
)
