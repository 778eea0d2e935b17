"""Column expressions: flags, identifiers, scores, cleaning rules."""

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from netloom.schema import NORMAL, TCP_FLAG_BITS


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_flag(flags, name: str) -> Column:
    """True when the TCP flag is set; a null flag field has no flags."""
    return F.coalesce(as_col(flags).bitwiseAND(TCP_FLAG_BITS[name]) != 0, F.lit(False))


def ends_flow(flags="tcp_flags") -> Column:
    return has_flag(flags, "fin") | has_flag(flags, "rst")


def syn_only(flags="tcp_flags") -> Column:
    return has_flag(flags, "syn") & ~has_flag(flags, "ack")


def session_id(src_ip="src_ip", src_port="src_port", dst_ip="dst_ip", dst_port="dst_port", protocol="protocol") -> Column:
    """`src:sport-dst:dport-proto`; an absent port is written `None`."""

    def port(c):
        return F.coalesce(as_col(c).cast("string"), F.lit("None"))

    return F.concat(
        as_col(src_ip), F.lit(":"), port(src_port), F.lit("-"),
        as_col(dst_ip), F.lit(":"), port(dst_port), F.lit("-"),
        as_col(protocol).cast("string"),
    )


def millis(t_us) -> Column:
    return F.floor(as_col(t_us) / F.lit(1000)).cast("bigint")


def event_id(session, event_type, label, t_us) -> Column:
    text = F.concat_ws(":", as_col(session), as_col(event_type), as_col(label), millis(t_us).cast("string"))
    return F.substring(F.sha2(text, 256), 1, 32)


def block_event_id(prefix: str, ip, t_us) -> Column:
    return F.concat_ws("-", F.lit(prefix), as_col(ip), millis(t_us).cast("string"))


def severity(label, confidence, threshold: float = 0.8) -> Column:
    return (
        F.when(as_col(label) == NORMAL, "low")
        .when(as_col(confidence) >= threshold, "high")
        .otherwise("medium")
    )


def risk_score(label, confidence, score) -> Column:
    """The larger of the attack confidence and the heuristic score on a 0..1 scale, 4 digits."""
    ml = F.when(as_col(label).isNull() | (as_col(label) == NORMAL), 0.0).otherwise(as_col(confidence))
    heuristic = F.least(F.lit(1.0), F.greatest(F.lit(0.0), as_col(score).cast("double") / 10))
    return F.round(F.greatest(ml, heuristic), 4)


def event_action(label) -> Column:
    return F.when(as_col(label) == NORMAL, "allow").otherwise("alert")


def session_action(state) -> Column:
    return F.when(as_col(state) == "active", "allowed").otherwise(as_col(state))


_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def _ipv4(c: Column) -> Column:
    return F.coalesce(c.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"), F.lit(False))


def blockable_ip(ip) -> Column:
    """A parseable address other than loopback.

    Only IPv4; use `mixed_blockable_ip` where v6 text may occur.
    """
    c = as_col(ip)
    return _ipv4(c) & ~c.startswith("127.")


def _ipv6_pattern() -> str:
    """IPv6 text: eight groups, or fewer around one `::`; the last two groups may be IPv4; a scope may follow."""
    h, v4 = "[0-9a-f]{1,4}", rf"{_OCTET}(?:\.{_OCTET}){{3}}"
    forms = [f"(?:{h}:){{7}}{h}", f"(?:{h}:){{6}}{v4}"]
    for before in range(8):
        head = f"(?:{h}:){{{before}}}:" if before else "::"
        after = 7 - before
        forms.append(head + (f"(?:(?:{h}:){{0,{after - 1}}}{h})?" if after else ""))
        if after >= 2:
            forms.append(f"{head}(?:{h}:){{0,{after - 2}}}{v4}")
    return f"(?i)^(?:{'|'.join(forms)})(?:%[^%/]+)?$"


_IPV6 = _ipv6_pattern()
#: Loopback, also as mapped IPv4; only for text that is IPv6.
_IPV6_LOOPBACK = r"(?i)^[0:]*:(?:0{0,3}1|0\.0\.0\.1|ffff:127\.[0-9.]+|ffff:7f[0-9a-f]{2}:[0-9a-f]{1,4})(?:%.*)?$"


def mixed_blockable_ip(ip) -> Column:
    """As `blockable_ip`, also for IPv6 text."""
    c = as_col(ip)
    v6 = c.rlike(_IPV6) & ~c.rlike(_IPV6_LOOPBACK)
    return blockable_ip(c) | F.coalesce(v6, F.lit(False))


def finite(c) -> Column:
    # NaN orders above every number, so one comparison covers NaN and both infinities.
    return F.coalesce(F.abs(as_col(c)) <= F.lit(sys.float_info.max), F.lit(False))


def numeric(c) -> Column:
    """Text or number as double; anything unreadable becomes null."""
    return F.trim(as_col(c).cast("string")).try_cast("double")


def sanitized(c) -> Column:
    value = numeric(c)
    return F.when(finite(value), value).otherwise(0.0)


def safe_rate(value, seconds) -> Column:
    d = as_col(seconds)
    return F.when(d > 0, as_col(value).cast("double") / d).otherwise(0.0)


def normalized_label(label) -> Column:
    """Attack family of a raw label; the order of the rules is part of the definition."""
    raw = F.trim(as_col(label))
    v = F.lower(raw)

    def holds(*parts):
        cond = F.lit(False)
        for part in parts:
            cond = cond | v.contains(part)
        return cond

    # Words that identify each family.
    return (
        F.when(v.isin("benign", "normal", "normal traffic"), NORMAL)
        .when(holds("ddos", "hoic", "loic"), "DDoS")
        .when(v.startswith("dos") | holds(" dos", "hulk", "goldeneye", "slowhttptest", "slowloris"), "DoS")
        .when(holds("bruteforce", "brute force"), "Brute Force")
        .when(v.isin("bot", "bots"), "Bots")
        .when(holds("web attack", "sql injection") | (v == "xss"), "Web Attacks")
        .when(holds("infilteration", "infiltration"), "Infiltration")
        .when(holds("heartbleed"), "Heartbleed")
        .otherwise(raw)
    )


def iso_time(t_us) -> Column:
    return F.timestamp_micros(as_col(t_us))
