"""Display text: run labels, step details, tree lines, finding sentences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DISPLAY_ZONE = "America/New_York"


def attribute(attributes: Column, key: str) -> Column:
    """One attribute as text; empty when it is missing.

    The bracket form of the path lets keys contain dots.
    """

    return F.coalesce(F.get_json_object(attributes, f"$['{key}']"), F.lit(""))


def run_label(service: Column, errors: Column, last_start: Column) -> Column:
    """``service · ok/fail · HH:MM:SS``. For display only: labels may repeat."""

    return F.concat(
        service,
        F.lit(" · "),
        F.when(errors > 0, F.lit("fail")).otherwise(F.lit("ok")),
        F.lit(" · "),
        F.date_format(F.from_utc_timestamp(last_start, DISPLAY_ZONE), "HH:mm:ss"),
    )


def step_detail(step_type: Column, attributes: Column) -> Column:
    """Who handed to whom, or which tool on which server."""

    return (
        F.when(
            step_type == "a2a_handoff",
            F.concat(attribute(attributes, "a2a.from"), F.lit(" → "), attribute(attributes, "a2a.to")),
        )
        .when(
            step_type == "tool_call",
            F.concat(attribute(attributes, "mcp.server"), F.lit("."), attribute(attributes, "mcp.tool")),
        )
        .otherwise(F.lit(""))
    )


def indented(name: Column, depth: Column, unit: str = "    ") -> Column:
    return F.concat(F.repeat(F.lit(unit), depth.cast("int")), name)


def fixed(value: Column, digits: int) -> Column:
    """A number with exactly ``digits`` decimals, rounded half-up as a decimal."""

    return F.round(value.cast("decimal(28,8)"), digits).cast(f"decimal(28,{digits})").cast("string")


def rounded(value: Column, digits: int) -> Column:
    """A double rounded half-up by its decimal digits, not its binary ones."""

    return F.round(value.cast("decimal(28,8)"), digits).cast("double")


def whole(value: Column) -> Column:
    """A number without decimals, ties to even."""

    return F.bround(value, 0).cast("bigint").cast("string")


def tree_line(node: dict[str, Column]) -> Column:
    """One indented line per span: agent, step type, name, cost, duration, flag."""

    depth = node["depth"].cast("int")
    duration = node["duration_ms"]
    return F.concat(
        F.repeat(F.lit("  "), depth),
        F.when(depth > 0, F.lit("+- ")).otherwise(F.lit("")),
        F.when(node["status"] == "error", F.lit("x ")).otherwise(F.lit("* ")),
        F.coalesce(node["agent_name"], F.lit("None")),
        F.lit(" | "),
        F.coalesce(node["step_type"], F.lit("None")),
        F.lit(" | "),
        F.coalesce(node["name"], F.lit("None")),
        F.lit(" ($"),
        fixed(F.coalesce(node["cost_usd"], F.lit(0.0)), 4),
        F.lit(", "),
        F.coalesce(F.concat(whole(duration), F.lit("ms")), F.lit("...")),
        F.lit(")"),
        F.when(node["orphaned"], F.lit("  [ORPHAN]")).otherwise(F.lit("")),
    )


def tidy_name(name: Column) -> Column:
    return F.replace(name, F.lit("->"), F.lit("→"))


def tidy_message(message: Column) -> Column:
    text = F.coalesce(message, F.lit(""))
    return F.replace(F.replace(text, F.lit('"'), F.lit("'")), F.lit("\n"), F.lit(" "))


def shown(value: Column) -> Column:
    """A value the way a sentence shows it, missing ones as ``None``."""

    return F.coalesce(value.cast("string"), F.lit("None"))


def loop_sentence(agent, step_type, name, count, limit: int) -> Column:
    return F.concat(
        shown(agent), F.lit(" repeated '"), shown(name), F.lit("' ("), shown(step_type), F.lit(") "),
        count.cast("string"), F.lit(f"x (threshold {limit})"),
    )


def failure_sentence(agent, name, count, limit: int) -> Column:
    return F.concat(
        shown(agent), F.lit("'s tool '"), shown(name), F.lit("' failed "),
        count.cast("string"), F.lit(f"x (threshold {limit})"),
    )


def cost_sentence(total, limit: float) -> Column:
    return F.concat(
        F.lit("run cost $"), fixed(total, 4), F.lit(f" exceeded limit ${limit:.4f}"),
    )
