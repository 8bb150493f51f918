"""Priority rules, validators and small arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .text import normalise, utf16_length


def default_priority(type_: Column) -> Column:
    out = F.lit(C.DEFAULT_PRIORITY)
    for name, value in C.TYPE_PRIORITY.items():
        out = F.when(type_ == name, value).otherwise(out)
    return out


def type_from_legacy(type_: Column) -> Column:
    return F.when(type_ == C.LEGACY_TYPE[0], C.LEGACY_TYPE[1]).otherwise(type_)


def resolve_priority(type_: Column, priority: Column, hot: Column, old_type: Column, old_priority: Column, old_hot: Column, old_explicit: Column) -> dict[str, Column]:
    """hot, priority, explicit of a fact being written; the old ones are null for a new fact."""
    now_hot = F.coalesce(hot, old_hot, F.lit(False))
    implicit = ~old_explicit
    kept = (
        F.when(now_hot & ~old_hot & implicit & (old_priority < C.HOT_PRIORITY), C.HOT_PRIORITY)
        .when(~now_hot & old_hot & implicit & (old_priority == C.HOT_PRIORITY), default_priority(type_))
        .when((type_ != old_type) & implicit & (old_priority == default_priority(old_type)), default_priority(type_))
        .otherwise(old_priority)
    )
    fresh = F.when(now_hot, C.HOT_PRIORITY).otherwise(default_priority(type_))
    return {
        "hot": now_hot,
        "priority": F.when(priority.isNotNull(), priority).when(old_type.isNotNull(), kept).otherwise(fresh).cast("int"),
        "explicit": F.when(priority.isNotNull(), True).otherwise(F.coalesce(old_explicit, F.lit(False))),
    }


def tier(priority: Column) -> Column:
    out = F.lit(C.TIERS[-1][1])
    for low, name in reversed(C.TIERS[:-1]):
        out = F.when(priority >= low, name).otherwise(out)
    return out


def ratio(over: Column, under: Column) -> Column:
    """over / under, 0 unless under is positive."""
    return F.when(under > 0, over / under).otherwise(F.lit(0.0))


def round2(x: Column) -> Column:
    """Two decimals, halves towards plus infinity."""
    return F.floor(x * 100 + 0.5) / 100


def fixed(x: Column, digits: int) -> Column:
    """With so many decimals, halves away from zero."""
    return F.format_string(f"%.{digits}f", F.signum(x) * F.floor(F.abs(x) * 10**digits + 0.5) / 10**digits)


def plain(x: Column) -> Column:
    """The shortest decimals of a share from 0 to 1, without a fraction where there is none."""
    return F.rtrim(F.rtrim(x.cast("decimal(38,20)").cast("string"), F.lit("0")), F.lit("."))


def valid_time(t: Column) -> Column:
    return t.isNotNull() & (t > 0) & (t <= C.MAX_TIME)


def valid_id(id_: Column) -> Column:
    return F.coalesce((F.length(id_) <= C.MAX_ID_CHARS) & id_.rlike(C.ID_PATTERN), F.lit(False))


def valid_text(text: Column) -> Column:
    return F.coalesce((text != "") & (utf16_length(text) <= C.MAX_FACT_CHARS) & (text == normalise(text)), F.lit(False))


def valid_reason(reason: Column) -> Column:
    """Absent (null here), or short and normalised."""
    return reason.isNull() | ((utf16_length(reason) <= C.MAX_REASON_CHARS) & (reason == normalise(reason)))


def reason(raw: Column) -> Column:
    """A reason as it is stored; a blank one is none. Whether it is too long, ``valid_reason`` tells."""
    return F.nullif(normalise(raw), F.lit(""))


def valid_fact(f: str = "") -> Column:
    c = lambda x: F.col(f + x)
    whole = lambda x: F.coalesce(x, F.lit(False))
    return (
        valid_id(c("id")) & whole(c("type").isin(*C.FACT_TYPES)) & valid_text(c("text"))
        & valid_time(c("created_at")) & valid_time(c("updated_at")) & whole(c("updated_at") >= c("created_at"))
        & whole(c("priority").between(0, 100)) & whole(c("revision") >= 1) & c("hot").isNotNull() & c("priority_explicit").isNotNull()
    )


def same_payload(a: str, b: str) -> Column:
    """All but id and revision equal."""
    out = F.lit(True)
    for x in ("type", "text", "created_at", "updated_at", "hot", "priority", "priority_explicit"):
        out = out & F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}"))
    return out


def split_model(raw: Column, provider: Column) -> dict[str, Column]:
    """provider and model of 'provider/model'; a given provider takes the whole as model."""
    text = F.trim(raw)
    at = F.instr(text, "/")
    given = F.coalesce(F.trim(provider), F.lit("")) != ""
    inside = (at > 1) & (at < F.length(text))
    return {
        "provider": F.when(given, F.trim(provider)).when(inside, F.substring(text, F.lit(1), at - 1)),
        "model": F.when(given & (text != ""), text).when(inside, F.substring(text, at + 1, F.length(text))),
    }
