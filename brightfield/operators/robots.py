"""Robots rules as a table, and requests matched against them.

The rule that matches the longest stretch of a request's path and query wins, "allow" on ties; "*" stands for any characters and a "$"
at the end for the end. Rules of a named agent stand for themselves; others take the rules for "*".

A rule's beginning up to its first "*" is a join key: every host's requests are cut to the lengths that the beginnings of its rules
have, and meet the rules in an equi-join. Equal requests are decided once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rules(body: Column) -> Column:
    """Rows (agents, allow, path) of a robots text; an agent's line is a row without a path, which tells that the agent is named."""
    lines = F.transform(F.split(body, "\\r?\\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    lines = F.filter(lines, lambda x: x.contains(":"))
    fields = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("field"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    row = "struct<agents:array<string>,allow:boolean,path:string>"
    start = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(False).alias("ruled"), F.array().cast(f"array<{row}>").alias("rows"))

    def step(s: Column, x: Column) -> Column:
        agent = F.array(F.lower(x["value"]))
        named = F.struct(agent.alias("agents"), F.lit(None).cast("boolean").alias("allow"), F.lit(None).cast("string").alias("path"))
        rule = F.struct(s["agents"].alias("agents"), (x["field"] == "allow").alias("allow"), x["value"].alias("path"))
        is_agent, is_rule = x["field"] == "user-agent", x["field"].isin("allow", "disallow") & (F.size(s["agents"]) > 0)
        return F.struct(
            F.when(is_agent & s["ruled"], agent).when(is_agent, F.concat(s["agents"], agent)).otherwise(s["agents"]).alias("agents"),
            F.when(is_agent, False).when(is_rule, True).otherwise(s["ruled"]).alias("ruled"),
            F.when(is_agent, F.concat(s["rows"], F.array(named))).when(is_rule, F.concat(s["rows"], F.array(rule))).otherwise(s["rows"]).alias("rows"),
        )

    return F.aggregate(fields, start, step, lambda s: s["rows"])


def robot_rules(texts: DataFrame, host: str = "host", body: str = "body") -> DataFrame:
    """(host, agent, allow, path) of robots texts, one per host; allow and path are null in the row that names an agent."""
    rows = texts.select(F.col(host).alias("host"), F.inline(_rules(F.col(body))))
    return rows.select("host", F.explode("agents").alias("agent"), "allow", "path").distinct()


def rules_for(rules: DataFrame, agent: str) -> DataFrame:
    """(host, allow, path, head, pattern) of the rules that an agent is under."""
    agent = agent.lower()
    mine = rules.where(F.col("agent").isin(agent, "*"))
    named = mine.groupBy("host").agg(F.bool_or(F.col("agent") == agent).alias("named"))
    mine = mine.join(named, "host").where((F.col("agent") == agent) == F.col("named")).where("path <> ''").select("host", "allow", "path").distinct()
    whole = F.col("path").endswith("$")
    body = F.when(whole, F.substring("path", F.lit(1), F.length("path") - 1)).otherwise(F.col("path"))
    quoted = F.replace(F.replace(body, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("*"), F.lit("\\E.*\\Q"))
    pattern = F.concat(F.lit("^\\Q"), quoted, F.lit("\\E"), F.when(whole, "$").otherwise(""))
    return mine.select("host", "allow", "path", F.substring_index(body, "*", 1).alias("head"), pattern.alias("pattern"))


def decided(requests: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """``requests`` (host, path, and others) with allowed, and the length that the winning rule matched (null: none did)."""
    rules = rules_for(rules, agent)
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("head")).alias("lengths"))
    asked = requests.select("host", "path").distinct().join(lengths, "host")
    cut = F.explode(F.filter("lengths", lambda n: n <= F.length("path")))
    heads = asked.select("host", "path", cut.alias("n")).select("host", "path", F.substring("path", F.lit(1), F.col("n")).alias("head"))
    met = heads.join(rules.withColumnRenamed("path", "rule"), ["host", "head"]).where("path RLIKE pattern")
    won = met.groupBy("host", "path").agg(F.max(F.struct(F.expr("length(regexp_extract(path, pattern, 0))").alias("length"), "allow")).alias("won"))
    made = requests.join(won, ["host", "path"], "left")
    return made.withColumn("allowed", F.coalesce("won.allow", F.lit(True))).withColumn("matched", F.col("won.length")).drop("won")
