"""Report and cover texts as tables of lines.

All inputs are per-host tables of bounded size: the header row, the app
totals, at most N listed incidents and at most M examples of each.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.fingerprint import short_fingerprint
from emberlog.functions.text import first_line, fmt_time, fmt_time_short, html_escape
from emberlog.functions.windows import Window as TimeWindow
from emberlog.functions.windows import timestamp
from emberlog.operators.ranking import order_columns

COVER_LIMIT = 4096

# The texts of the report and the cover.
REPORT = {
    "title": "# Отчёт по ошибкам: `%s`%s",
    "period": "**Период:** %s — %s (%s)",
    "generated": "**Сгенерирован:** %s",
    "totals": "**Итого:** error = **%d**, critical = **%d**, записей всего: **%d**, инцидентов (fingerprint'ов): **%d**",
    "nothing": "За окно ошибок уровня `error` / `critical` не обнаружено.",
    "open": "[Открыть в Grafana →](%s)",
    "apps": "## Агрегаты по приложениям",
    "apps_head": "| app | error | critical | всего |",
    "apps_rule": "|-----|------:|---------:|------:|",
    "app": "| `%s` | %d | %d | %d |",
    "top": "## Топ-%d инцидентов",
    "incident": "### %d. [`%s`] %s",
    "count": "- **count:** %d",
    "level": "- **level:** `%s`",
    "module": "- **module:** `%s`",
    "seen": "- **first / last:** %s → %s",
    "fingerprint": "- **fingerprint:** `%s` (уникальных стримов: %d)",
    "link": "- **Grafana:** [посмотреть %d событий →](%s)",
    "examples": "Выдержки:",
    "fence": "```",
    "below": "## Прочее (ниже шум-порога K=%d)",
    "below_counts": "**%d** инцидентов, **%d** записей. [Открыть в Grafana →](%s)",
}
COVER = {
    "title": "<b>Ежедневный отчёт об ошибках торговых серверов</b>",
    "period": "<b>Период:</b> %s — %s (%s)",
    "hosts": "<b>Итог по серверам:</b>",
    "head": "<pre>%-10s %6s %6s  %s",
    "columns": ("host", "error", "crit", "top-app"),
    "row": "%-10s %6d %6d  %s",
    "end": "</pre>",
    "totals": "<b>Всего:</b> %d error, %d critical",
    "incidents": "<b>Уникальных инцидентов:</b> %d",
    "link": '<a href="%s">Открыть все за сутки в Grafana →</a>',
    "partial": "<i>[partial-report] один или несколько хостов не были собраны, детали — в логах daemon'а.</i>",
}


def _t(name: str, *args) -> Column:
    return F.format_string(REPORT[name], *args) if args else F.lit(REPORT[name])


def _lines(df: DataFrame, section: int, item: Column, lines: Column) -> DataFrame:
    return df.select(
        "host", F.lit(section).alias("section"), item.cast("long").alias("item"),
        F.posexplode(lines).alias("pos", "line"),
    )


def report_lines(
    hosts: DataFrame, apps: DataFrame, top: DataFrame, examples: DataFrame,
    window: TimeWindow, tz: str, noise_k: int, generated_at: datetime,
) -> DataFrame:
    """(host, ord, line); the lines of a host joined by newlines are its report.

    hosts: host, label, error, critical, total, incidents, listed, below,
    below_records, link. apps: see ``app_totals``. top: see ``top_incidents``,
    with ``link``. examples: host, fingerprint, example_no, msg.
    """
    none, blank = F.array().cast("array<string>"), F.lit("")
    label = F.when(F.col("label") != "", F.format_string(" (%s)", "label")).otherwise("")
    lo, hi = window.bounds
    is_empty = F.col("total") == 0
    head = F.concat(
        F.array(
            _t("title", F.col("host"), label), blank,
            _t("period", fmt_time(lo, tz), fmt_time(hi, tz), F.lit(tz)),
            _t("generated", fmt_time(timestamp(generated_at), tz)), blank,
            _t("totals", F.col("error"), F.col("critical"), F.col("total"), F.col("incidents")), blank,
        ),
        F.when(is_empty, F.array(_t("nothing"), blank, _t("open", F.col("link")), blank)).otherwise(
            F.array(_t("apps"), blank, _t("apps_head"), _t("apps_rule"))
        ),
    )
    reported = hosts.filter(~is_empty)
    list_head = F.array(blank, blank, _t("top", F.col("listed")), blank)
    tail = F.when(
        F.col("below") > 0,
        F.array(_t("below", F.lit(noise_k)), blank,
                _t("below_counts", F.col("below"), F.col("below_records"), F.col("link")), blank, blank, blank),
    ).otherwise(F.array(blank, blank))

    app_order = Window.partitionBy("host").orderBy(*order_columns(["-total", "app"]))
    app_rows = apps.withColumn("_no", F.row_number().over(app_order))

    incident = F.concat(
        F.array(_t("incident", F.col("rank"), F.col("app"), first_line("normalized_msg")), blank,
                _t("count", F.col("cnt")), _t("level", F.col("level"))),
        F.when(F.col("module") != "", F.array(_t("module", F.col("module")))).otherwise(none),
        F.array(_t("seen", fmt_time("first_seen", tz), fmt_time("last_seen", tz)),
                _t("fingerprint", short_fingerprint(), F.col("streams")),
                _t("link", F.col("cnt"), F.col("link")), blank, _t("examples"), blank),
    )
    # examples follow their incident: 0 = the incident, 1..M = examples, then the end
    place = F.col("rank") * 1_000_000
    shown = examples.join(top.select("host", "fingerprint", "rank"), ["host", "fingerprint"])

    parts = [
        _lines(hosts, 0, F.lit(0), head),
        _lines(app_rows, 1, F.col("_no"), F.array(_t("app", F.col("app"), F.col("error"), F.col("critical"), F.col("total")))),
        _lines(reported, 2, F.lit(0), list_head),
        _lines(top, 3, place, incident),
        _lines(shown, 3, place + F.col("example_no"), F.array(_t("fence"), F.col("msg"), _t("fence"), blank)),
        _lines(top, 3, place + 999_999, F.array(blank, blank)),
        _lines(reported, 4, F.lit(0), tail),
    ]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    order = Window.partitionBy("host").orderBy("section", "item", "pos")
    return lines.select("host", F.row_number().over(order).alias("ord"), "line")


def report_bodies(lines: DataFrame) -> DataFrame:
    """One report text per host."""
    ordered = F.sort_array(F.collect_list(F.struct("ord", "line")))
    return lines.groupBy("host").agg(F.array_join(ordered["line"], "\n").alias("body"))


def cover_rows(hosts: DataFrame) -> DataFrame:
    """Padded table row of each host (host, host_no, error, critical, top_app)."""
    return hosts.select(
        "host_no", "host",
        F.format_string(COVER["row"], "host", "error", "critical", html_escape("top_app")).alias("line"),
    )


def cover(
    hosts: DataFrame, window: TimeWindow, tz: str, link: Column, partial: bool = False
) -> DataFrame:
    """Cover text of the digest, one row, with its length check. ``hosts`` is
    the configured list (host_no, host, error, critical, incidents, top_app)."""
    lo, hi = window.bounds
    rows = F.sort_array(F.collect_list(F.struct("host_no", "line")))["line"]
    summed = cover_rows(hosts).join(hosts.select("host_no", "error", "critical", "incidents"), "host_no").agg(
        rows.alias("rows"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("error", "critical", "incidents")],
    )
    text = F.array_join(
        F.concat(
            F.array(
                F.lit(COVER["title"]),
                F.format_string(COVER["period"], fmt_time_short(lo, tz), fmt_time_short(hi, tz), F.lit(tz)),
                F.lit(""), F.lit(COVER["hosts"]), F.lit(COVER["head"] % COVER["columns"]),
            ),
            F.col("rows"),
            F.array(
                F.lit(COVER["end"]), F.lit(""),
                F.format_string(COVER["totals"], "error", "critical"),
                F.format_string(COVER["incidents"], "incidents"), F.lit(""),
                F.format_string(COVER["link"], F.coalesce(link, F.lit(""))), F.lit(""),
                F.lit(COVER["partial"] if partial else ""), F.lit(""),
            ),
        ),
        "\n",
    )
    return summed.select(text.alias("body")).withColumns(
        {"chars": F.length("body"), "fits": F.length("body") <= COVER_LIMIT}
    )
