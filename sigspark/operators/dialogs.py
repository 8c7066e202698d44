"""Sessionization of messages into dialogs, and their state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.functions.sip import digits, transaction_key, uri_user
from sigspark.operators.ordered import number_rows
from sigspark.session import stage

# The kind of a dialog by the method that opens it.
KIND_BY_METHOD = {
    "INVITE": "call", "REGISTER": "register", "OPTIONS": "options", "SUBSCRIBE": "subscribe",
    "NOTIFY": "notify", "MESSAGE": "message",
}


def group_dialogs(df: DataFrame, keys: Sequence[str], tag_from: str, tag_to: str, order: Sequence[str]) -> DataFrame:
    """Add ``dialog_tag``: the tag that opened the dialog a row belongs to, per ``keys``.

    The sequential rule: a row joins the earliest dialog whose opening tag is its from- or to-tag,
    else it opens a dialog under its from-tag. Rows without a from-tag share the tag ''.

    The rule depends on a row only through its pair of tags and the pair's first appearance, so it
    is decided on distinct pairs, which combine before the shuffle. A pair surely opens a dialog
    when no earlier pair has one of its tags as from-tag. Where every other pair meets such a
    dialog, these are all dialogs there are; the remaining keys are decided in rounds.
    """
    keys = list(keys)
    tagged = df.withColumn("_f", F.coalesce(F.col(tag_from), F.lit(""))).withColumn(
        "_t", F.when(F.col(tag_to) != "", F.col(tag_to))
    )
    pairs = tagged.groupBy(*keys, "_f", "_t").agg(F.min(F.struct(*order)).alias("_at"))
    checked = _covered(pairs, _sure(pairs, keys), keys)
    open_keys = checked.where(~F.col("_sure") & ~F.col("_met")).select(*keys).distinct()
    rest = stage(pairs.join(open_keys, keys, "left_semi"), "open-dialogs")
    legs = _sure(pairs.join(open_keys, keys, "left_anti"), keys)
    if not rest.isEmpty():
        legs = legs.unionByName(_rounds(rest, keys))
    owner = _assign(pairs, legs, keys)
    renamed = owner.select(*[F.col(k).alias("_k_" + k) for k in keys], F.col("_f").alias("_pf"), F.col("_t").alias("_pt"), "dialog_tag")
    cond = (F.col("_f") == F.col("_pf")) & F.col("_t").eqNullSafe(F.col("_pt"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col("_k_" + k))
    return tagged.join(renamed, cond, "left").drop(*["_k_" + k for k in keys], "_pf", "_pt", "_f", "_t")


def _first_as_from(pairs: DataFrame, keys) -> DataFrame:
    return pairs.groupBy(*keys, "_f").agg(F.min("_at").alias("_m"))


def _sure(pairs: DataFrame, keys) -> DataFrame:
    """Dialogs that must open: (keys, tag, at) of pairs with no earlier pair from one of their tags."""
    firsts = _first_as_from(pairs, keys)
    own = firsts.select(*keys, "_f", F.col("_m").alias("_own"))
    other = firsts.select(*keys, F.col("_f").alias("_t"), F.col("_m").alias("_other"))
    seen = pairs.join(own, [*keys, "_f"]).join(other, [*keys, "_t"], "left")
    sure = (F.col("_at") == F.col("_own")) & (F.col("_other").isNull() | (F.col("_other") >= F.col("_at")))
    return seen.where(sure).groupBy(*keys, F.col("_f").alias("_tag")).agg(F.min("_at").alias("_opened"))


def _covered(pairs: DataFrame, legs: DataFrame, keys) -> DataFrame:
    """Pairs with ``_sure`` (opens a dialog itself) and ``_met`` (finds an earlier one)."""
    by_from = legs.select(*keys, F.col("_tag").alias("_f"), F.col("_opened").alias("_of"))
    by_to = legs.select(*keys, F.col("_tag").alias("_t"), F.col("_opened").alias("_ot"))
    out = pairs.join(by_from, [*keys, "_f"], "left").join(by_to, [*keys, "_t"], "left")
    sure = F.coalesce(F.col("_of") == F.col("_at"), F.lit(False))
    met = F.coalesce(F.col("_of") < F.col("_at"), F.lit(False)) | F.coalesce(F.col("_ot") < F.col("_at"), F.lit(False))
    return out.withColumn("_sure", sure).withColumn("_met", met)


def _rounds(pairs: DataFrame, keys) -> DataFrame:
    """Exact decision by rounds: open what no undecided earlier pair can prevent, drop what meets an
    open dialog, repeat. Each round decides at least the first pair of every key."""
    legs = None
    while True:
        new = _sure(pairs, keys)
        legs = stage(new if legs is None else legs.unionByName(new), "dialogs")
        state = _covered(pairs, legs, keys)
        pairs = stage(state.where(~F.col("_sure") & ~F.col("_met")).select(*keys, "_f", "_t", "_at"), "open-dialogs")
        if pairs.isEmpty():
            return legs


def _assign(pairs: DataFrame, legs: DataFrame, keys) -> DataFrame:
    out = _covered(pairs, legs, keys)
    of = F.when(F.col("_of") <= F.col("_at"), F.struct(F.col("_of").alias("at"), F.col("_f").alias("tag")))
    ot = F.when(F.col("_ot") <= F.col("_at"), F.struct(F.col("_ot").alias("at"), F.col("_t").alias("tag")))
    return out.select(*keys, "_f", "_t", F.least(of, ot)["tag"].alias("dialog_tag"))


def sip_dialogs(messages: DataFrame, prefix: str = "d") -> tuple[DataFrame, DataFrame]:
    """(legs, leg_messages) of parsed messages; every message lands in exactly one leg."""
    base = messages.withColumn("_call", F.coalesce("call_id", F.lit("")))
    if "ord" not in base.columns:
        base = base.withColumn("ord", F.col("msg_id"))
    tagged = group_dialogs(base, ["capture_id", "_call"], "from_tag", "to_tag", ["ts", "ord"])
    legs = dialog_state(tagged, ["capture_id", "_call", "dialog_tag"])
    legs = number_rows(legs, ["capture_id"], ["start_ts", "first_ord"], prefix, "leg_id")
    bridge = legs.select(
        F.col("capture_id"), F.col("_call"), F.col("dialog_tag"), "leg_id", F.col("kind").alias("leg_kind")
    )
    leg_messages = tagged.join(bridge, ["capture_id", "_call", "dialog_tag"]).drop("_call", "dialog_tag")
    return legs.drop("_call", "dialog_tag", "first_ord"), leg_messages


def dialog_state(leg_messages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per dialog: kind, ends, learned tags, first INVITE and the call state.

    Every attribute is an aggregate that combines on the map side; order enters through min_by and
    max_by over (ts, ord).
    """
    at = F.struct("ts", "ord")
    request, method, status = F.col("is_request"), F.col("method"), F.col("status")
    for_invite = F.col("cseq.method") == "INVITE"
    final = ~request & (status >= 200)

    def first(value: Column, cond: Column) -> Column:
        return F.min_by(value, F.when(cond, at))

    own = F.col("dialog_tag") == F.coalesce("from_tag", F.lit(""))
    learned = F.when(own, F.col("to_tag")).when(F.col("dialog_tag") == F.col("to_tag"), F.col("from_tag"))
    learned = F.when((F.col("dialog_tag") == "") & own, F.col("to_tag")).otherwise(learned)
    agg = leg_messages.groupBy(*keys).agg(
        F.min_by(
            F.struct(
                "is_request", "method", "from_uri", "to_uri", "from_tag", "to_tag", "src", "dst",
                "sport", "dport", "transport", "call_id", "ord",
            ),
            at,
        ).alias("f"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count(F.lit(1)).alias("n_messages"),
        first(learned, learned.isNotNull() & (learned != "")).alias("to_tag"),
        first(F.col("msg_id"), request & (method == "INVITE")).alias("invite_id"),
        F.min(F.when(final & for_invite & (status < 300), F.col("ts"))).alias("_ok_ts"),
        F.max((final & (status < 300)).cast("int")).alias("_any_ok"),
        first(status, final & for_invite & (status >= 300)).alias("_call_fail"),
        first(status, final & (status >= 300)).alias("_any_fail"),
        F.max((request & (method == "BYE")).cast("int")).alias("_bye"),
        F.min(F.when(request & (method == "CANCEL"), at)).alias("_cancel"),
        F.max(F.when(~request & for_invite & (status == 487), at)).alias("_487"),
    )
    kinds = F.create_map(*[F.lit(x) for kv in KIND_BY_METHOD.items() for x in kv])
    initial = F.col("f.is_request") & (F.coalesce(F.col("f.to_tag"), F.lit("")) == "")
    kind = F.when(initial, F.coalesce(F.try_element_at(kinds, F.col("f.method")), F.lit("other"))).otherwise("other")
    is_call = F.col("kind") == "call"
    answered = is_call & F.col("_ok_ts").isNotNull()
    canceled = F.coalesce(F.col("_cancel") < F.col("_487"), F.lit(False))
    call_state = (
        F.when(answered & (F.col("_bye") == 1), "completed")
        .when(canceled, "canceled")
        .when(~answered & F.col("_call_fail").isNotNull(), "failed")
        .when(answered, "answered")
        .when(F.col("invite_id").isNotNull(), "no-answer")
        .otherwise("in-progress")
    )
    other_state = (
        F.when(F.col("_any_ok") == 1, "completed").when(F.col("_any_fail").isNotNull(), "failed").otherwise("in-progress")
    )
    fail = F.when(is_call, F.col("_call_fail")).otherwise(F.col("_any_fail"))
    return (
        agg.withColumn("kind", kind)
        .withColumn("protocol", F.lit("sip"))
        .withColumn("answered", answered)
        .withColumn("answer_ts", F.when(is_call, F.col("_ok_ts")))
        .withColumn("state", F.when(is_call, call_state).otherwise(other_state))
        .withColumn("fail_code", F.when(F.col("state") == "failed", fail))
        .select(
            *keys, "protocol", "kind", "state", "fail_code", "answered", "answer_ts", "start_ts", "end_ts",
            "n_messages", "invite_id", "to_tag", F.nullif(F.col("f.from_tag"), F.lit("")).alias("from_tag"),
            F.col("f.from_uri").alias("from_uri"), F.col("f.to_uri").alias("to_uri"),
            uri_user(F.col("f.from_uri")).alias("from_user"), uri_user(F.col("f.to_uri")).alias("to_user"),
            F.col("f.src").alias("src"), F.col("f.dst").alias("dst"), F.col("f.sport").alias("sport"),
            F.col("f.dport").alias("dport"), F.col("f.transport").alias("transport"),
            F.col("f.call_id").alias("call_id"), F.col("f.ord").alias("first_ord"),
        )
    )


def group_flows(q931: DataFrame, prefix: str = "g") -> tuple[DataFrame, DataFrame]:
    """(legs, leg_messages) of Q.931 messages: one leg per direction-free flow and call reference."""
    a = F.concat_ws(":", "src", F.col("sport").cast("string"))
    b = F.concat_ws(":", "dst", F.col("dport").cast("string"))
    base = q931.withColumn("_flow", F.concat_ws("|", F.least(a, b), F.greatest(a, b)))
    if "ord" not in base.columns:
        base = base.withColumn("ord", F.col("msg_id"))
    at = F.struct("ts", "ord")
    kind = F.col("q931_type")

    def first(value, cond):
        return F.min_by(value, F.when(cond, at))

    ends = F.struct("src", "dst", "sport", "dport")
    keys = ["capture_id", "_flow", "call_ref"]
    agg = base.groupBy(*keys).agg(
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count(F.lit(1)).alias("n_messages"),
        F.coalesce(first(ends, kind == "SETUP"), F.min_by(ends, at)).alias("e"),
        first(F.col("calling"), kind == "SETUP").alias("from_uri"),
        first(F.col("called"), kind == "SETUP").alias("to_uri"),
        first(F.col("guid"), F.col("guid").isNotNull()).alias("guid"),
        F.min(F.when(kind == "CONNECT", F.col("ts"))).alias("answer_ts"),
        F.max((kind == "ALERTING").cast("int")).alias("_alerting"),
        first(F.struct("cause_code"), kind == "RELEASE COMPLETE").alias("_release"),
        first(F.col("msg_id"), kind == "SETUP").alias("invite_id"),
        F.min_by("ord", at).alias("first_ord"),
    )
    released, cause = F.col("_release").isNotNull(), F.col("_release.cause_code")
    answered = F.col("answer_ts").isNotNull()
    state = (
        F.when(released & answered, "completed")
        .when(released & cause.isin(18, 19), "no-answer")
        .when(released & (cause == 16) & (F.col("_alerting") == 1), "canceled")
        .when(released, "failed")
        .when(answered, "answered")
        .otherwise("in-progress")
    )
    legs = (
        agg.withColumn("state", state)
        .withColumn("fail_code", F.when(F.col("state") == "failed", cause))
        .withColumn("protocol", F.lit("h323"))
        .withColumn("kind", F.lit("call"))
        .withColumn("answered", answered)
        .withColumn("from_user", F.nullif(digits(F.col("from_uri")), F.lit("")))
        .withColumn("to_user", F.nullif(digits(F.col("to_uri")), F.lit("")))
        .withColumn("transport", F.lit("tcp"))
        .select("*", "e.*")
        .drop("e", "_alerting", "_release")
    )
    legs = number_rows(legs, ["capture_id"], ["start_ts", "first_ord"], prefix, "leg_id")
    bridge = base.join(legs.select(*keys, "leg_id"), keys)
    return legs.drop("_flow", "first_ord"), bridge.drop("_flow")


def transactions(leg_messages: DataFrame) -> DataFrame:
    """Per transaction of a leg: worst status, rows, repeats, state."""
    key = transaction_key(F.coalesce(F.col("cseq.method"), F.col("method")), F.col("cseq.num"), F.col("branch"))
    return transaction_rollup(
        leg_messages.withColumn("tx_key", key), ["capture_id", "leg_id", "tx_key"], "status", F.sha2("raw", 256)
    )


def transaction_rollup(df: DataFrame, keys: Sequence[str], status: str, identity: Column) -> DataFrame:
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(status).alias("worst_status"),
        (F.count(F.lit(1)) - F.countDistinct(identity)).alias("n_repeats"),
    )
    s = F.col("worst_status")
    return out.withColumn(
        "tx_state",
        F.when(s.isNull(), "unanswered").when(s < 200, "pending").when(s < 300, "ok").otherwise("failed"),
    )


def offer_answer(leg_messages: DataFrame, statuses: Sequence[int] | None = None) -> DataFrame:
    """Per leg the first request with a session description and the first answer to it.

    ``statuses`` limits the answers (e.g. 183 and 200); by default any from 180 to 299.
    """
    has_sdp = leg_messages.where(F.col("sdp").isNotNull()).withColumn("cseq_num", F.col("cseq.num"))
    key = ["capture_id", "leg_id"]
    at = F.struct("ts", "ord")
    row = F.struct("msg_id", "ts", "sdp", "cseq_num")
    offers = has_sdp.where(F.col("is_request")).groupBy(*key).agg(F.min_by(row, at).alias("offer"))
    ok = F.col("status").isin(list(statuses)) if statuses else F.col("status").between(180, 299)
    answers = has_sdp.where(~F.col("is_request") & ok).groupBy(*key, "cseq_num").agg(F.min_by(row, at).alias("answer"))
    offers = offers.withColumn("cseq_num", F.col("offer.cseq_num"))
    return offers.join(answers, [*key, "cseq_num"], "left")


def finals_for(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Final responses of each request: same leg and sequence number, not before it."""
    key = ["capture_id", "leg_id", "cseq_num"]
    r = responses.where(F.col("status") >= 200).select(
        *key, F.col("msg_id").alias("response_id"), F.col("ts").alias("response_ts"), "status"
    )
    q = requests.select(*key, F.col("msg_id").alias("request_id"), F.col("ts").alias("request_ts"), "method")
    return q.join(r, key).where(F.col("response_ts") >= F.col("request_ts"))


def bridges(leg_messages: DataFrame, call_legs: DataFrame) -> DataFrame:
    """message -> leg -> call, calls null for legs outside any."""
    return leg_messages.select("capture_id", "msg_id", "leg_id").join(
        call_legs.select("capture_id", "leg_id", "call_no"), ["capture_id", "leg_id"], "left"
    )
