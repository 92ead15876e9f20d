"""Names of models, datasets, runs and output files."""

from pyspark.sql import Column, functions as F

from answerloom import fixed_values as fv
from answerloom.functions.basics import case_map


def short_model_name(model: Column) -> Column:
    """The part after the last slash."""
    return F.substring_index(model, "/", -1)


def dataset_name(path: Column, explicit: Column | None = None) -> Column:
    """data/<name>/.. and data/<name>.csv give <name>; other paths their stem."""
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    second = F.try_element_at(steps, F.lit(2))
    inside_data = ~path.startswith("/") & (F.try_element_at(steps, F.lit(1)) == "data")
    stem = F.regexp_replace(F.try_element_at(steps, F.lit(-1)), r"(?s)(?<=.)\.[^.]+\z", "")
    name = F.when(
        inside_data & second.isNotNull(), F.regexp_replace(second, r"\.csv\z", "")
    ).otherwise(stem)
    if explicit is None:
        return name
    return F.when(F.coalesce(explicit, F.lit("")) != "", explicit).otherwise(name)


def title_case(text: Column) -> Column:
    """Every run of letters capitalised, as Python's str.title() does."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(
        F.transform(
            runs,
            lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))),
        ),
        "",
    )


def model_group(run: Column, groups: dict = fv.RUN_GROUPS) -> Column:
    """The model behind a run's name; names not listed are their own group."""
    return F.when(run.startswith(fv.GPT_RUN_PREFIX), fv.GPT_GROUP).otherwise(
        case_map(run, groups, default=run)
    )


def model_display(group: Column, names: dict = fv.MODEL_DISPLAY) -> Column:
    plain = title_case(F.replace(group, F.lit("/"), F.lit(" ")))
    return case_map(group, names, default=plain)


def model_order(group: Column, order: dict = fv.MODEL_ORDER) -> Column:
    return case_map(group, order, default=F.lit(fv.UNKNOWN_MODEL_ORDER))


def evaluation_run_name(model: Column, mode: Column, run: Column, runs: Column) -> Column:
    """<model>_<mode>, with _run<n> only where there are several runs."""
    base = F.concat_ws("_", short_model_name(model), mode)
    return F.when(runs > 1, F.concat(base, F.lit("_run"), run.cast("string"))).otherwise(base)


def generated_file_name(
    correct: Column, partial: Column, incorrect: Column, model: Column, mode: Column
) -> Column:
    return F.format_string(
        "student_answers_c%d_p%d_i%d_%s_%s.csv", correct, partial, incorrect, model, mode
    )


def plain_number(value: Column) -> Column:
    """A double as Python writes it: 0.0005 and 1e-05, not 5.0E-4 and 1.0E-5."""
    text = value.cast("double").cast("string")
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E", -1).try_cast("int")
    sign = F.when(value < 0, "-").otherwise("")
    digits = F.regexp_replace(mantissa, "[-.]", "")
    long_form = F.regexp_replace(value.try_cast("decimal(38,12)").cast("string"), r"(\.\d+?)0+$", "$1")
    return (
        F.when(~F.contains(text, F.lit("E")), text)
        .when(power == -4, F.concat(sign, F.lit("0.000"), digits))
        .when(power < -4, F.concat(mantissa, F.lit("e-"), F.lpad((-power).cast("string"), 2, "0")))
        .otherwise(long_form)
    )


def grid_run_name(rate: Column, rank: Column, alpha: Column, dropout: Column, batch: Column) -> Column:
    return F.format_string(
        "lr_%s_r_%d_alpha_%.1f_drop_%s_bs_%d", plain_number(rate), rank, alpha,
        plain_number(dropout), batch,
    )


def adapter_run_name(model: Column, adapter_path: Column | None) -> Column:
    """eval_<model>_<last step of the adapter path>, or eval_<model>_base."""
    suffix = F.lit("base")
    if adapter_path is not None:
        suffix = F.coalesce(F.substring_index(adapter_path, "/", -1), suffix)
    return F.concat_ws("_", F.lit("eval"), short_model_name(model), suffix)
