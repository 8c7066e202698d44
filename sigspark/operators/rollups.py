"""Grouped summaries: exchanges, flows, causes, traffic, product figures, retention."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.operators.ordered import epoch_us
from sigspark.plans.slices import row_number, scan, top_per

SEVERITIES = ["crit", "warn", "notice", "info"]


def severity_rank(severity: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in enumerate(SEVERITIES) for x in reversed(kv)])
    return F.coalesce(F.try_element_at(ranks, severity), F.lit(len(SEVERITIES)))


def by_severity(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return df.orderBy(severity_rank(F.col("severity")), *order)


def count_by(df: DataFrame, keys: Sequence[str], by: str, values: Sequence[str]) -> DataFrame:
    """One column per value with its count, in one aggregate."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(by) == v).alias(v) for v in values])


def capture_stats(messages: DataFrame) -> DataFrame:
    return messages.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("n_messages"), F.count_if(F.col("is_request")).alias("n_requests"),
        F.count_if(~F.col("is_request")).alias("n_responses"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.sort_array(F.collect_set(F.lower("transport"))).alias("transports"),
        ((F.max(epoch_us(F.col("ts"))) - F.min(epoch_us(F.col("ts")))) / 1e6).alias("span_s"),
    )


def pair_key(src="src", sport="sport", dst="dst", dport="dport") -> Column:
    a = F.concat_ws(":", src, F.col(sport).cast("string"))
    b = F.concat_ws(":", dst, F.col(dport).cast("string"))
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def pair_rollup(stun: DataFrame) -> DataFrame:
    """Candidate pairs: checks, outcomes, smallest round trip, nomination, state."""
    from sigspark.operators.pairing import pair_by_id

    base = stun.withColumn("pair", pair_key())
    flows = base.groupBy("capture_id", "pair").agg(
        F.count_if(F.col("class") == "request").alias("n_requests"), F.count_if(F.col("class") == "success").alias("n_successes"),
        F.count_if(F.col("class") == "error").alias("n_errors"), F.max(F.coalesce("use_candidate", F.lit(False))).alias("nominated"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("username", F.when(F.col("username").isNotNull(), F.col("ts"))).alias("username"),
        F.sort_array(F.collect_set("error_code")).alias("error_codes"),
    )
    tx = pair_by_id(base.where(F.col("class").isin("request", "success", "error")).select("capture_id", "txid", "ts", "class", "pair"), ["capture_id", "txid"], F.col("class") == "request", "ts", "class")
    rtt = tx.groupBy("capture_id", F.col("request_pair").alias("pair")).agg(
        F.min("rtt_us").alias("min_rtt_us"), F.count_if(F.col("response_ts").isNull()).alias("n_unanswered")
    )
    state = F.when(F.col("n_successes") > 0, "succeeded").when(F.col("n_errors") > 0, "failed").otherwise("no-response")
    return flows.join(rtt, ["capture_id", "pair"], "left").withColumn("state", state)


def handshake_rollup(dtls: DataFrame) -> DataFrame:
    """Handshakes per flow: complete when both sides changed cipher and finished, else the last step."""
    base = dtls.withColumn("pair", pair_key()).withColumn("way", F.concat_ws(":", "src", F.col("sport").cast("string")))
    step = F.when(F.col("content_type") == 20, "ChangeCipherSpec").when(F.col("content_type") == 22, F.col("handshake"))
    out = base.withColumn("step", step).groupBy("capture_id", "pair").agg(
        F.countDistinct(F.when(F.col("content_type") == 20, F.col("way"))).alias("n_ccs"),
        F.countDistinct(F.when(F.col("handshake").isin("Finished", "Encrypted"), F.col("way"))).alias("n_finished"),
        F.max_by("step", F.when(F.col("step").isNotNull(), F.col("ts"))).alias("last_step"),
        F.min_by("alert", F.when(F.col("alert.level") == "fatal", F.col("ts"))).alias("fatal"),
        F.max("profile").alias("profile"), F.count_if(F.col("content_type") == 23).alias("n_data"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    done = (F.col("n_ccs") >= 2) & (F.col("n_finished") >= 2)
    return out.withColumn("complete", done).withColumn("stalled_after", F.when(~done, F.col("last_step"))).withColumn("fatal_alert", F.when(~done, F.col("fatal.description"))).drop("fatal", "last_step")


def exchange_stats(exchanges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per name: exchanges, unanswered, slow, worst latency, failures."""
    rcode = F.col("response_rcode")
    return exchanges.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("timed_out")).alias("n_timeouts"), F.count_if(F.col("slow")).alias("n_slow"),
        F.max("latency_us").alias("max_latency_us"), F.count_if(rcode.isNotNull() & (rcode != "NOERROR")).alias("n_failures"),
        F.sort_array(F.collect_set("request_qtype")).alias("qtypes"),
    )


def exchange_aliases(exchanges: DataFrame) -> DataFrame:
    """Evidence by name, base name and resolved address: one row per alias of an exchange."""
    q = F.lower(F.regexp_replace("request_qname", r"\.$", ""))
    base = F.nullif(F.regexp_replace(q, r"^(?:_[^.]*\.)+", ""), q)
    addresses = F.transform(F.filter(F.coalesce("response_answers", F.array().cast("array<struct<name:string,type:string,ttl:bigint,value:string>>")), lambda a: a["type"].isin("A", "AAAA")), lambda a: a["value"])
    alias = F.explode(F.array_distinct(F.concat(F.array_compact(F.array(q, base)), addresses)))
    out = exchanges.select("capture_id", alias.alias("alias"), "timed_out", "slow", "latency_us")
    return out.groupBy("capture_id", "alias").agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if("timed_out").alias("n_timeouts"), F.count_if("slow").alias("n_slow"), F.max("latency_us").alias("max_latency_us")
    )


def activity(exchanges: DataFrame, by: Sequence[str], failure_from: int = 3000) -> DataFrame:
    """Requests per command with failures and unanswered ones."""
    code = F.coalesce("response_result_code", "response_experimental_code")
    return exchanges.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_requests"), F.count_if(code >= failure_from).alias("n_failures"), F.count_if(F.col("timed_out")).alias("n_unanswered")
    )


def class_disagreement(df: DataFrame, left: str, right: str, left_map: DataFrame, right_map: DataFrame, compatible: DataFrame) -> DataFrame:
    """Rows whose two codes belong to classes that do not go together.

    The maps are lookup tables (code, class); ``compatible`` lists class pairs that agree.
    """
    out = df.join(left_map.select(F.col("code").alias(left), F.col("class").alias("left_class")), left)
    out = out.join(right_map.select(F.col("code").alias(right), F.col("class").alias("right_class")), right)
    return out.join(compatible, ["left_class", "right_class"], "left_anti")


def cause_tally(df: DataFrame, by: Sequence[str], lookup: DataFrame) -> DataFrame:
    """Release causes by source and code with their severity."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return n.join(lookup, "code", "left").withColumn("severity", F.coalesce("severity", F.lit("notice")))


def upper_median(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str]) -> DataFrame:
    """The element at position floor(n/2) of the sorted values, counted from 0."""
    known = df.where(F.col(value).isNotNull()).select(*keys, value, *tie)
    n = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = scan(known, keys, [value, *tie], {"_r": row_number()})
    return ranked.join(n, list(keys)).where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(*keys, F.col(value).alias("upper_median"))


def common_prefix(df: DataFrame, keys: Sequence[str], text: Column) -> DataFrame:
    """Longest common prefix of a group: that of its smallest and largest member."""
    from sigspark.functions.sip import _common_prefix_len

    ends = df.groupBy(*keys).agg(F.min(text).alias("_a"), F.max(text).alias("_b"))
    return ends.select(*keys, F.substring(F.col("_a"), F.lit(1), _common_prefix_len(F.col("_a"), F.col("_b"))).alias("prefix"))


# ---- traffic and product figures ----------------------------------------------------------------

# Parts of user agents that name a program, of paths that nothing on the site links to, and endings of files that are no page.
PROGRAMS = ["bot", "crawl", "spider", "scan", "fetch", "monitor", "uptime", "preview", "headless", "curl/", "wget/", "python", "java/", "okhttp", "libwww", "httpclient"]
TRAPS = ["/.", "/wp-", "/admin", "/phpmyadmin", "/cgi-bin", "/actuator", "/solr", "/shell", "/vendor/", "/config", ".php", ".asp", ".jsp", ".sql", ".bak"]
FILES = ["css", "js", "map", "json", "xml", "txt", "ico", "png", "jpg", "jpeg", "gif", "webp", "svg", "woff", "woff2", "ttf", "pdf", "zip"]


def _has_any(text: Column, parts: Sequence[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(Column.__or__, [low.contains(p) for p in parts], F.lit(False))


def with_traffic_class(log: DataFrame, programs: Sequence[str] = PROGRAMS, traps: Sequence[str] = TRAPS, files: Sequence[str] = FILES) -> DataFrame:
    """Flags is_probe, is_bot, is_css, is_view of access-log rows; the lists are the caller's to change."""
    probe = _has_any(F.col("path"), traps)
    bot = probe | _has_any(F.col("ua"), programs)
    ending = F.lower(F.regexp_extract(F.coalesce("path", F.lit("")), r"\.([A-Za-z0-9]+)(?:\?.*)?$", 1))
    return log.select(
        "*", probe.alias("is_probe"), bot.alias("is_bot"), (~bot & (ending == "css")).alias("is_css"), (~bot & ~ending.isin(list(files))).alias("is_view"),
    )


def percent(n: Column, d: Column) -> Column:
    """Whole percent, null without a denominator: zero and unknown differ."""
    return F.when(d > 0, F.floor(100.0 * n / d + 0.5).cast("bigint"))


def traffic(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    c = with_traffic_class(log)
    known = F.col("ip") != "-"
    out = c.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("is_bot").alias("bots"), F.count_if("is_probe").alias("probes"),
        F.count_if(~F.col("is_bot")).alias("humans"), F.count_if("is_view").alias("views"), F.count_if("is_css").alias("css_hits"),
        F.countDistinct(F.when(~F.col("is_bot") & known, F.col("ip"))).alias("networks"),
        F.countDistinct(F.when(F.col("is_bot") & known, F.col("ip"))).alias("bot_networks"),
    )
    return out.withColumn("bot_share", percent(F.col("bots"), F.col("requests"))).withColumn("css_ratio", percent(F.col("css_hits"), F.col("views")))


def top_paths(log: DataFrame, by: Sequence[str] = (), n: int = 8) -> DataFrame:
    views = with_traffic_class(log).where("is_view").groupBy(*by, F.substring_index("path", "?", 1).alias("path")).agg(F.count(F.lit(1)).alias("views"))
    if by:
        return top_per(views, by, [F.col("views").desc(), F.col("path")], n)
    return views.orderBy(F.col("views").desc(), "path").limit(n)


def kpis(users: DataFrame, captures: DataFrame, now: Column, owner_map: DataFrame | None = None) -> DataFrame:
    """Signups, activity, activation and conversion of accounts, one row.

    ``users``: user_id, plan, created_at, last_login_at. ``captures``: owner_id, uploaded_at. A user
    is active under the account ``owner_map`` (user_id, owner_id) gives, else under their own id.
    """
    owned = users.withColumn("owner_id", F.col("user_id"))
    if owner_map is not None:
        owned = users.join(owner_map.select("user_id", F.col("owner_id").alias("_o")), "user_id", "left").withColumn("owner_id", F.coalesce("_o", "user_id")).drop("_o")
    have = captures.groupBy("owner_id").agg(F.count(F.lit(1)).alias("_n"))
    u = owned.join(have, "owner_id", "left")

    def since(col, days):
        return F.count_if(F.col(col) >= now - F.expr(f"INTERVAL {days} DAYS"))

    out = u.agg(
        F.count(F.lit(1)).alias("users"), since("created_at", 7).alias("signups_7d"), since("created_at", 30).alias("signups_30d"),
        since("last_login_at", 7).alias("active_7d"), F.count_if(F.col("_n") > 0).alias("activated"), F.count_if(F.col("plan") == "paid").alias("paid"),
    )
    return out.withColumn("activation_pct", percent(F.col("activated"), F.col("users"))).withColumn("conversion_pct", percent(F.col("paid"), F.col("users")))


def weekly_digest(feedback: DataFrame, ts: str = "ts", kind: str = "kind", rating: str = "rating") -> DataFrame:
    """Feedback per ISO week and kind: rows, rated rows and their mean."""
    week = F.concat(
        F.extract(F.lit("YEAROFWEEK"), F.col(ts)).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0")
    )
    return feedback.groupBy(week.alias("week"), kind).agg(
        F.count(F.lit(1)).alias("n"), F.count(rating).alias("n_rated"), F.round(F.avg(rating), 1).alias("mean_rating")
    )


def unsent_weeks(digest: DataFrame, sent: DataFrame) -> DataFrame:
    """Digest rows of weeks not sent yet: each week goes out once."""
    return digest.join(sent.select("week").distinct(), "week", "left_anti")


def dormancy(teams: DataFrame, members: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Teams by days since their owner was last seen, and whether another paid member could take over.

    ``teams``: team_id, owner_id. ``members``: team_id, user_id, plan, last_seen.
    """
    m = members.join(teams, "team_id").groupBy("team_id").agg(
        F.max(F.when(F.col("user_id") == F.col("owner_id"), F.col("last_seen"))).alias("owner_seen"),
        F.count_if((F.col("user_id") != F.col("owner_id")) & (F.col("plan") == "paid")).alias("paid_members"),
    )
    idle = F.floor((epoch_us(now) - epoch_us(F.col("owner_seen"))) / 86_400_000_000).cast("bigint")
    out = m.withColumn("idle_days", idle)
    state = F.when(F.col("idle_days").isNull(), "unknown").when(F.col("idle_days") < days, "active").when(F.col("paid_members") > 0, "claimable").otherwise("dormant")
    return out.withColumn("state", state)


def retention_plan(meta: DataFrame, days: int, now: Column, ts: str = "uploaded_at") -> DataFrame:
    """Each row's fate by age in whole days: keep up to ``days``, keep undated rows; 0 or less disables."""
    age = F.floor((epoch_us(now) - epoch_us(F.col(ts))) / 86_400_000_000).cast("bigint")
    out = meta.withColumn("age_days", age)
    if days <= 0:
        return out.withColumn("fate", F.lit("disabled"))
    fate = F.when(F.col("age_days").isNull(), "skipped-undated").when(F.col("age_days") <= days, "keep").otherwise("remove")
    return out.withColumn("fate", fate)
