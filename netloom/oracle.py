"""DuckDB statements that compute the registered queries straight from their definitions.

They use other means than the Spark jobs on purpose: correlated window joins, row by row
recursion over sessions and block requests, plain counting.
"""

from netloom.catalog import FEATURE_GROUPS, REPORT_DAY_US
from netloom.schema import BAD_LABELS, FEATURES, RAW_MICROS, RAW_TO_FEATURE, WHOLE_FEATURES

CTE: dict[str, str] = {}

CTE["packets"] = """
select packet_id, t_us, wall_us, src_ip, dst_ip, protocol, packet_size,
 case when protocol=1 then null else sp end as src_port,
 case when protocol=1 then null else dp end as dst_port,
 case when protocol=6 then fl end as tcp_flags,
 case when protocol=6 then 1024*(1+packet_id%64) end as tcp_window_size,
 case when protocol=6 then 20+4*(packet_id%3) end as tcp_header_length,
 case when protocol=6 then 20+4*(packet_id%3) else 8 end as transport_header_length,
 case when packet_size>60 then packet_size-60 else 0 end as payload_size
from (
 select event_id as packet_id, epoch_us(ts) as wall_us,
  ((epoch_us(ts)-1704067200000000)//86400000000)*(case when user_id%2=0 then 20000000 else 40000000 end)
   + ((epoch_us(ts)-1704067200000000)%86400000000)//43200 as t_us,
  '10.0.0.'||(1+user_id%8) as src_ip, '10.1.0.'||(1+user_id%3) as dst_ip,
  cast(case when event_id%10=0 then 17 when event_id%10=1 then 1 else 6 end as integer) as protocol,
  case when event_id%97=0 then 0 when event_id%89=0 then 30 else 40+cast(floor(value*100) as bigint)%1400 end as packet_size,
  40000+user_id%4 as sp,
  case when user_id%8=3 then 1+event_id%200 when user_id%4=0 then 22 when user_id%4=1 then 80 when user_id%4=2 then 443 else 8080 end as dp,
  cast(case when user_id%8=5 then 2 when event_type='signup' then 2 when event_type='view' then 16 when event_type='click' then 24
   when event_type='purchase' then (case when value>200 then 17 else 16 end)
   else (case when value>150 then 4 else 18 end) end as integer) as fl
 from events)"""

SID = "src_ip||':'||coalesce(cast(src_port as varchar),'None')||'-'||dst_ip||':'||coalesce(cast(dst_port as varchar),'None')||'-'||protocol"
FIN = "coalesce(tcp_flags & 1 <> 0 or tcp_flags & 4 <> 0, false)"
SYN = "coalesce(tcp_flags & 2 <> 0 and tcp_flags & 16 = 0, false)"

CTE["scored"] = f"""
select *, {SID} as session_id,
 case when packet_id%3=0 then 'Normal Traffic' when dst_port=22 then 'Brute Force' when tcp_flags=2 then 'DDoS'
  when tcp_flags=4 then 'DoS' else 'Bots' end as label,
 cast(50+packet_id*37%50 as double)/100 as confidence,
 case when packet_id%4=0 then 'Normal Traffic' when packet_id%3=0 then 'Normal Traffic' when dst_port=22 then 'Brute Force'
  when tcp_flags=2 then 'DDoS' when tcp_flags=4 then 'DoS' else 'Bots' end as shadow_label,
 cast(40+packet_id*53%60 as double)/100 as shadow_confidence,
 {FIN} as is_final,
 case when {FIN} then 'ml_completed_flow_prediction' else 'ml_live_prediction' end as event_type
from packets"""


def event_id(sid, kind, label, t):
    return f"substr(sha256({sid}||':'||{kind}||':'||{label}||':'||(({t})//1000)),1,32)"


SEV = "case when {0}='Normal Traffic' then 'low' when {1}>=0.8 then 'high' else 'medium' end"

CTE["events_in"] = f"""
select {event_id("session_id", "event_type", "label", "wall_us")} as event_id, wall_us as ts_us, packet_id,
 src_ip as source, case when packet_id%2=0 then src_ip end as source_ip, dst_ip as destination_ip,
 src_port as source_port, dst_port as destination_port, protocol, 'primary' as model, label as prediction,
 case when packet_id%5=0 then label end as attack_type, confidence,
 case when packet_id%7=0 then confidence end as confidence_score,
 case when packet_id%2=1 then event_type end as detection_method,
 case when label='Normal Traffic' then 'allow' else 'alert' end as action,
 session_id, is_final
from scored"""

CTE["evts"] = f"""
select event_id, ts_us, packet_id, source, coalesce(source_ip,source) as source_ip, destination_ip, source_port,
 destination_port, protocol, model, prediction, coalesce(attack_type,prediction) as attack_type, confidence,
 coalesce(confidence_score,confidence) as confidence_score, event_id as threat_id,
 coalesce(detection_method,'ml') as detection_method, action, action as action_taken, confidence as risk_score,
 session_id, is_final, {SEV.format("prediction", "confidence")} as severity
from events_in"""

_DEDUP = "'alert:v1:'||substr(sha256(lower(trim(session_id))||'|'||lower(trim(source))||'|'||lower(trim(attack_type))||'|'||lower(trim(action))),1,32)"
CTE["alert_rows"] = f"select *, {_DEDUP} as dedup_key from evts where prediction<>'Normal Traffic'"
CTE["alerts"] = f"""
select dedup_key, event_id, prediction, confidence, action, source, threat_id, detection_method, action_taken, session_id,
 source_ip, destination_ip, source_port, destination_port, protocol, risk_score, is_final, first_seen_us, last_seen_us,
 occurrence_count, {SEV.format("prediction", "confidence")} as severity, 'open' as status, substr(dedup_key,10) as id
from (select *, min(ts_us) over (partition by dedup_key) as first_seen_us, max(ts_us) over (partition by dedup_key) as last_seen_us,
  count(*) over (partition by dedup_key) as occurrence_count,
  row_number() over (partition by dedup_key order by ts_us desc, packet_id desc) as rn from alert_rows) where rn=1"""
CTE["threats"] = """
select threat_id, last_seen_us as ts_us, source_ip, source_port, destination_ip, destination_port, protocol,
 prediction as attack_type, severity, confidence as confidence_score, detection_method, action_taken, status, session_id, id as alert_id
from alerts"""

CTE["seqd"] = f"select *, {SID} as flow_id, {FIN} as fin, row_number() over (partition by {SID} order by t_us, packet_id) as rn from packets"
CTE["st"] = """
select flow_id, rn, t_us, packet_id, fin, t_us as start_us, packet_id as start_packet, cast(null as bigint) as iat_us from seqd where rn=1
union all
select n.flow_id, n.rn, n.t_us, n.packet_id, n.fin,
 case when s.fin or n.t_us-s.t_us>=30000000 or n.t_us-s.start_us>=120000000 then n.t_us else s.start_us end,
 case when s.fin or n.t_us-s.t_us>=30000000 or n.t_us-s.start_us>=120000000 then n.packet_id else s.start_packet end,
 case when s.fin or n.t_us-s.t_us>=30000000 or n.t_us-s.start_us>=120000000 then null else n.t_us-s.t_us end
from st s join seqd n on n.flow_id=s.flow_id and n.rn=s.rn+1"""
CTE["assigned"] = """
select p.*, st.flow_id, st.start_us, st.start_packet, st.iat_us, st.fin,
 row_number() over (partition by st.flow_id, st.start_us, st.start_packet order by p.t_us, p.packet_id) as packet_no
from packets p join st using (packet_id)"""
CTE["sess"] = """
select *, case when finished then 'flow_end' when least(end_us+30000000,start_us+120000000)>(select max(t_us) from packets) then 'active'
 when end_us+30000000<=start_us+120000000 then 'idle_timeout' else 'max_duration' end as reason
from (select flow_id, start_us, start_packet, src_ip, dst_ip, src_port, dst_port, protocol, max(t_us) as end_us, count(*) as packet_count,
  cast(sum(packet_size) as bigint) as byte_count, bool_or(fin) as finished, max(t_us)-start_us as duration_us
 from assigned group by flow_id, start_us, start_packet, src_ip, dst_ip, src_port, dst_port, protocol)"""

_RAW_MEASURES = {
    "n": "count(*)",
    "end_us": "max(t_us)",
    "bytes": "cast(sum(packet_size) as bigint)",
    "bytes_sq": "cast(sum(packet_size*packet_size) as bigint)",
    "size_min": "min(packet_size)",
    "size_max": "max(packet_size)",
    "gaps": "count(iat_us)",
    "gap_sum": "coalesce(cast(sum(iat_us) as bigint),0)",
    "gap_sq": "coalesce(sum(cast(iat_us as hugeint)*iat_us),0)",
    "gap_min": "coalesce(min(iat_us),0)",
    "gap_max": "coalesce(max(iat_us),0)",
    "header": "cast(sum(transport_header_length) as bigint)",
    "window0": "coalesce(arg_min(tcp_window_size, t_us*100000000+packet_id) filter (tcp_window_size is not null),0)",
    "data_packets": "count(*) filter (payload_size>0)",
    "payload_min": "coalesce(min(payload_size) filter (payload_size>0),0)",
    **{k: f"count(*) filter (tcp_flags & {b} <> 0)" for k, b in dict(fin=1, syn=2, rst=4, psh=8, ack=16, urg=32).items()},
}
_MEASURES = ", ".join(f"{v} as {'f_' + k if k in ('fin', 'syn', 'rst', 'psh', 'ack', 'urg') else k}" for k, v in _RAW_MEASURES.items())
CTE["measures"] = f"""
select flow_id, start_us, start_packet, src_ip, dst_ip, src_port, dst_port, protocol, {_MEASURES} from assigned group by all"""
_DUR = "(cast(end_us-start_us as double)/1e6)"
_SVAR = "(case when n>=2 then cast(cast(n as hugeint)*bytes_sq-cast(bytes as hugeint)*bytes as double)/cast(n*n as double) else 0 end)"
_GVAR = "(case when gaps>=2 then cast(cast(gaps as hugeint)*gap_sq-cast(gap_sum as hugeint)*gap_sum as double)/cast(gaps*gaps as double) else 0 end)"
_RATE = "(case when end_us>start_us then cast({0} as double)/" + _DUR + " else 0 end)"
_F = {
    "dst_port": "coalesce(dst_port,0)",
    "protocol": "protocol",
    "flow_duration": _DUR,
    "total_fwd_packets": "n",
    "total_fwd_bytes": "bytes",
    "flow_bytes_per_sec": _RATE.format("bytes"),
    "flow_packets_per_sec": _RATE.format("n"),
    "fwd_packets_per_sec": _RATE.format("n"),
    "packet_len_min": "size_min",
    "packet_len_max": "size_max",
    "packet_len_mean": "cast(bytes as double)/n",
    "packet_len_std": f"sqrt{_SVAR}",
    "packet_len_variance": _SVAR,
    "avg_packet_size": "cast(bytes as double)/n",
    "flow_iat_min": "gap_min/1e6",
    "flow_iat_max": "gap_max/1e6",
    "flow_iat_mean": "(case when gaps>0 then cast(gap_sum as double)/gaps else 0 end)/1e6",
    "flow_iat_std": f"sqrt{_GVAR}/1e6",
    "fwd_iat_total": "gap_sum/1e6",
    "fwd_header_length": "header",
    "init_win_bytes_forward": "window0",
    "act_data_pkt_fwd": "data_packets",
    "min_seg_size_forward": "payload_min",
}
for _s in ("min", "max", "mean", "std"):
    _F[f"fwd_packet_len_{_s}"] = _F[f"packet_len_{_s}"]
    _F[f"fwd_iat_{_s}"] = _F[f"flow_iat_{_s}"]
for _k in ("fin", "syn", "rst", "psh", "ack", "urg"):
    _F[f"{_k}_flag_count"] = f"f_{_k}"
_FEATURE_LIST = ", ".join(f"cast({_F[f]} as double) as {f}" for f in FEATURES)
CTE["feats"] = f"select flow_id, start_us, start_packet, src_ip, dst_ip, src_port, dst_port as dport, protocol as proto, end_us, n, bytes, {_FEATURE_LIST} from measures"
CTE["ruled"] = """
select *, case when dst_port=22 and n>=5 then 'Brute Force' when syn_flag_count>ack_flag_count then 'DDoS' when rst_flag_count>0 then 'DoS'
 else 'Normal Traffic' end as label, cast(50+n%50 as double)/100 as confidence from feats"""
CTE["session_rows"] = """
select s.flow_id as session_id, s.start_us as start_time_us, s.end_us as end_time_us, s.src_ip as source_ip, s.protocol, s.packet_count,
 s.byte_count, case when r.label='Normal Traffic' then 0 else r.confidence end as risk, s.reason as state, r.label as ml_prediction
from sess s join ruled r using (flow_id, start_us, start_packet)"""

# Scoring points: row by row per session; c and l are packet number and time of the last one.
CTE["trig"] = """
select flow_id, start_us, start_packet, packet_no, packet_id, t_us, fin, fin as hit, case when fin then packet_no else 0 end as c,
 case when fin then t_us else start_us end as l from assigned where packet_no=1
union all
select n.flow_id, n.start_us, n.start_packet, n.packet_no, n.packet_id, n.t_us, n.fin,
 n.fin or (n.t_us-n.start_us>=1000000 and n.packet_no>=5 and (s.c=0 or n.packet_no-s.c>=5 or n.t_us-s.l>=1000000)),
 case when n.fin or (n.t_us-n.start_us>=1000000 and n.packet_no>=5 and (s.c=0 or n.packet_no-s.c>=5 or n.t_us-s.l>=1000000)) then n.packet_no else s.c end,
 case when n.fin or (n.t_us-n.start_us>=1000000 and n.packet_no>=5 and (s.c=0 or n.packet_no-s.c>=5 or n.t_us-s.l>=1000000)) then n.t_us else s.l end
from trig s join assigned n on n.flow_id=s.flow_id and n.start_us=s.start_us and n.start_packet=s.start_packet and n.packet_no=s.packet_no+1"""

CTE["win"] = """
select p.packet_id,
 count(*) filter (q.t_us>=p.t_us-2000000)>=40 as scan_burst,
 count(distinct q.dst_port)>=15 as port_sweep,
 count(*) filter (q.t_us>=p.t_us-3000000 and q.tcp_flags & 2 <> 0 and q.tcp_flags & 16 = 0)>=20 as syn_only_surge
from packets p join packets q on q.src_ip=p.src_ip and q.t_us between p.t_us-5000000 and p.t_us and (q.t_us<p.t_us or q.packet_id<=p.packet_id)
group by p.packet_id"""
_SENS = "coalesce(dst_port in (21,22,23,25,53,80,110,135,139,143,443,445,3389), false)"
_PARTS = [
    ("no_transport_ports", "(src_port is null and dst_port is null)", 2),
    ("invalid_packet_size", "(packet_size<=0)", 3),
    ("tiny_packet", "(packet_size<40)", 1),
    ("sensitive_service_probe", _SENS, 1),
    ("scan_burst", "scan_burst", 3),
    ("port_sweep", "port_sweep", 3),
    ("syn_only_surge", "syn_only_surge", 4),
]


def _decide(parts):
    score = "+".join(f"case when {c} then {v} else 0 end" for _, c, v in parts)
    names = "concat_ws(','," + ",".join(f"case when {c} then '{n}' end" for n, c, _ in parts) + ")"
    return f"cast({score} as integer) as score, case when {names}='' then 'clean' else {names} end as reason"


CTE["stateless"] = f"select *, score>=2 as suspicious from (select *, {_decide(_PARTS[:4])} from packets)"
CTE["heur"] = f"select *, score>=2 as suspicious from (select *, {_decide(_PARTS)} from packets join win using (packet_id))"
CTE["brute"] = """
select p.*, (select count(*) from packets q where q.src_ip=p.src_ip and q.dst_ip=p.dst_ip and q.dst_port=p.dst_port
  and q.t_us between p.t_us-90000000 and p.t_us and (q.t_us<p.t_us or q.packet_id<=p.packet_id))>=25 as bruteforce
from packets p where dst_port in (21,22,23,25,110,143,3389)"""


def _requests(body):
    return f"select *, row_number() over (partition by ip order by t_us, seq) as rn from ({body})"


def _req(kind, dur, order, attack, conf, source, cond):
    return (
        f"select src_ip as ip, t_us, packet_id*4+{order} as seq, {kind} as kind, cast({dur} as bigint) as duration_s, {attack} as attack_type, "
        f"cast({conf} as double) as confidence, packet_id, src_ip, src_port, dst_ip, dst_port, protocol from {source} where {cond}"
    )


_ML = _req("case when is_final then 'ml_final' else 'ml_live' end", 900, "(case when is_final then 3 else 2 end)", "label", "confidence", "scored",
           "label<>'Normal Traffic' and confidence>=0.8")
_AUTO_REQS = (
    _req("'heuristic'", 300, 0, "'Heuristic Suspicious Activity'", "least(0.99, cast(score as double)/10)", "heur", "score>=3")
    + " union all "
    + _req("'bruteforce'", 600, 1, "'Brute Force'", "0.9", "brute", "bruteforce")
    + f" union all {_ML}"
)
CTE["autoreqs"] = _requests(_AUTO_REQS)
# All producers in one order per address; commands come before the packets of their moment.
CTE["reqs"] = _requests(
    f"{_AUTO_REQS} union all by name select ip, t_us, seq-4611686018427387904 as seq, 'command' as kind, duration_s, command_id, action, broken from cmds"
)
CTE["mlreqs"] = _requests(_ML)


def _fold(src):
    """Block decisions request by request. `lastb`/`until` are null while not blocked or cooling."""

    def step(t, d, lb, un):
        return (
            f"case when {lb} is not null and not ({un}<={t}) and {t}-{lb}<60000000 then 'cooldown_active' "
            f"when {un} is not null and {un}>{t} then 'already_blocked' else 'blocked' end"
        )

    s = step("n.t_us", "n.duration_s", "s.lastb", "s.until")
    return f"""
select *, 'blocked' as status, t_us as lastb, t_us+duration_s*1000000 as until from {src} where rn=1
union all
select n.*, {s}, case when {s}='cooldown_active' then s.lastb else n.t_us end,
 case when {s}='cooldown_active' then s.until else n.t_us+n.duration_s*1000000 end
from {{me}} s join {src} n on n.ip=s.ip and n.rn=s.rn+1"""


CTE["dec"] = _fold("autoreqs").format(me="dec")
CTE["mldec"] = _fold("mlreqs").format(me="mldec")
_ACT = "case o_orderpriority when '1-URGENT' then 'block' when '2-HIGH' then 'unblock' when '3-MEDIUM' then 'watchlist' when '4-NOT SPECIFIED' then 'unwatchlist' else 'reboot' end"
_FIRST = "(o_orderkey - case when o_orderkey%10=1 then 1 when o_orderkey%10=2 and (o_orderkey//640)%2=1 then 640 else 0 end)"
_CIP = f"case when {_FIRST}%29=0 then '' when {_FIRST}%23=0 then 'not-an-ip' when {_FIRST}%19=0 then '127.0.0.1' else '10.0.0.'||(1+{_FIRST}%12) end"
CTE["commands"] = f"""
select 'c-'||{_FIRST} as command_id, o_orderkey as seq, o_orderkey*100000 as t_us, {_ACT} as action,
 {_CIP} as ip, case when o_custkey%3=0 then 300+o_custkey%50 end as duration_seconds from orders"""
CTE["cmds"] = """
select command_id, seq, t_us, action, ip, coalesce(duration_seconds,300) as duration_s,
 case when ip='' then 'invalid_command' when action='reboot' then 'unsupported_action' when action='unwatchlist' then null
  when ip in ('not-an-ip','127.0.0.1') then 'invalid_or_loopback_ip' end as broken from commands"""


def _cmd_step(a, t, lb, un, w):
    return (
        f"case when {a}='unblock' then 'unblocked' when {a}='watchlist' then 'watchlisted' "
        f"when {a}='unwatchlist' then (case when {w} then 'unwatchlisted' else 'not_watchlisted' end) "
        f"when {lb} is not null and not ({un}<={t}) and {t}-{lb}<60000000 then 'cooldown_active' "
        f"when {un} is not null and {un}>{t} then 'already_blocked' else 'blocked' end"
    )


# One command after the other, with the ids that succeeded so far: a known id first, then the command's own faults, then its outcome.
_S1 = f"case when broken='invalid_command' then broken when list_contains(done, command_id) then 'duplicate_command' when broken is not null then broken else {_cmd_step('action', 't_us', 'lastb', 'until', 'watched')} end"
_FAILED = "('invalid_command','unsupported_action','invalid_or_loopback_ip','cooldown_active','not_watchlisted')"
_AUTO = _cmd_step("'block'", "t_us", "lastb", "until", "watched")
CTE["fold"] = f"""
select ip, cast(0 as bigint) as rn, '' as status, cast(null as bigint) as lastb, cast(null as bigint) as until, false as watched, cast([] as varchar[]) as done from (select distinct ip from reqs)
union all
select ip, rn, status,
 case when status='unblocked' then null when status in ('blocked','already_blocked') then t_us else lastb end,
 case when status='unblocked' then null when status in ('blocked','already_blocked') then t_us+duration_s*1000000 else until end,
 case status when 'watchlisted' then true when 'unwatchlisted' then false else watched end,
 case when kind<>'command' or status in {_FAILED} or status='duplicate_command' then done else list_append(done, command_id) end
from (select n.ip, n.rn, n.kind, n.command_id, n.t_us, n.duration_s, s.lastb, s.until, s.watched, s.done, case when kind='command' then {_S1} else {_AUTO} end as status
 from fold s join reqs n on n.ip=s.ip and n.rn=s.rn+1)"""
CTE["settled"] = "select r.*, f.status, f.until from reqs r join fold f using (ip, rn)"
CTE["all_dec"] = "select * from settled where status in ('blocked','already_blocked','unblocked','cooldown_active')"
for _all in ("", "all_"):
    CTE[_all + "acc"] = f"""
select *, lead(t_us) over (partition by ip order by rn) as next_us, lead(seq) over (partition by ip order by rn) as next_seq
from {_all}dec where status<>'cooldown_active'"""
    CTE[_all + "flagged"] = f"""
select p.packet_id, p.src_ip, p.t_us from packets p where exists (
 select 1 from {_all}acc a where a.ip=p.src_ip and p.t_us<a.until and (p.t_us>a.t_us or (p.t_us=a.t_us and p.packet_id*4>a.seq))
 and (a.next_us is null or p.t_us<a.next_us or (p.t_us=a.next_us and p.packet_id*4<=a.next_seq)))"""
CTE["watched"] = """
select p.packet_id, p.src_ip, p.t_us from packets p asof join (select ip, t_us, arg_max(status, seq) as status from settled where status in ('watchlisted','unwatchlisted') group by ip, t_us) w
on p.src_ip=w.ip and p.t_us>=w.t_us where w.status='watchlisted'"""
CTE["feed"] = """
select src_ip as ip, t_us, packet_id as tie, reason as attack_type, 'allowed' as action from heur where suspicious
union all select ip, t_us, packet_id, attack_type, case when status='cooldown_active' then 'allowed' else 'blocked' end from all_dec where kind not in ('heuristic','command')
union all select ip, t_us, -1, case status when 'blocked' then 'block_action' when 'unblocked' then 'manual_unblock' else 'already_blocked_activity' end, case status when 'unblocked' then 'unblocked' else 'blocked' end from all_acc
union all select ip, until, -1, 'unblock_action', 'unblocked' from all_acc where until<=coalesce(next_us,(select max(t_us) from packets))
union all select src_ip, t_us, packet_id, 'blocked_ip_activity', 'blocked' from all_flagged
union all select src_ip, t_us, packet_id, 'watchlisted_ip_activity', 'watchlisted' from watched
union all select ip, t_us, seq+4611686018427387904, 'watchlist_action', status from settled where status in ('watchlisted','unwatchlisted')"""

CTE["blocks"] = """
select 'b-'||o_orderkey as event_id, 1704067200000000+o_orderkey*173000000%2592000000000 as ts_us, '10.0.0.'||(1+o_custkey%12) as source_ip,
 case o_orderpriority when '1-URGENT' then (case when o_orderkey%2=0 then 'block' else 'blocked' end) when '2-HIGH' then 'unblocked'
  when '3-MEDIUM' then (case when o_orderkey%2=0 then 'watchlist' else 'watchlisted' end) when '4-NOT SPECIFIED' then 'unwatchlisted' else 'allowed' end as action_taken,
 'reason_'||(o_custkey%4) as reason, case when o_custkey%2=0 then 'manual' else 'heuristic' end as detection_method,
 case when o_orderkey%2=0 then '10.0.0.'||(1+o_custkey%12)||':40000-10.1.0.'||(1+o_custkey%3)||':22-6' end as session_id,
 case when o_orderpriority='1-URGENT' then 1704067200000000+o_orderkey*173000000%2592000000000+2700000000 end as expires_us
from orders"""
_NORM = "case action_taken when 'block' then 'blocked' when 'watchlist' then 'watchlisted' else action_taken end"
CTE["last_block"] = f"select *, {_NORM} as st, row_number() over (partition by source_ip order by ts_us desc, event_id desc) as rn from blocks"
CTE["control"] = """
select l.source_ip as ip_address, l.st as current_status, l.detection_method as control_source, l.reason,
 (select min(ts_us) from last_block b where b.source_ip=l.source_ip and b.st='blocked') as first_blocked_us, l.ts_us as last_changed_us,
 case when l.st='blocked' then l.expires_us end as expires_us, l.event_id as last_block_event_id, l.session_id as last_session_id
from last_block l where rn=1"""

CTE["snaps"] = """
select s*30000000 as snapshot_us,
 (select count(*) from packets where t_us<=s*30000000) as received_total,
 (select count(*) from packets where packet_size=0 and t_us<=s*30000000) as dropped_total,
 (select count(*) from packets where payload_size>0 and t_us<=s*30000000) as predictions_total,
 (select count(*) from packets where protocol=6 and t_us<=s*30000000) as shadow_total,
 (select count(*) from packets where t_us<=s*30000000 and t_us>(s-1)*30000000) as received_per_window,
 (select count(*) from packets where packet_size=0 and t_us<=s*30000000 and t_us>(s-1)*30000000) as dropped_per_window,
 (select count(*) from packets where payload_size>0 and t_us<=s*30000000 and t_us>(s-1)*30000000) as predictions_per_window,
 (select count(*) from packets where protocol=6 and t_us<=s*30000000 and t_us>(s-1)*30000000) as shadow_per_window
from (select unnest(generate_series((select cast(ceil(min(t_us)/3e7) as bigint) from packets), (select cast(ceil(max(t_us)/3e7) as bigint) from packets))) as s)"""

CTE["screens"] = """
select 'r-'||(doc_id-case when doc_id%3=1 then 1 else 0 end) as request_id, doc_id*1000000 as ts_us, source, substr(text,1,255) as query_preview,
 doc_id%4=0 as detected, cast(60+doc_id%40 as double)/100 as confidence from documents"""
CTE["decisions"] = """
select request_id, ts_us, source, query_preview, detected, confidence, case when detected then 'block' else 'allow' end as decision,
 cast(case when detected then 400 else 200 end as integer) as http_status
from (select *, row_number() over (partition by request_id order by ts_us) as rn from screens) where rn=1"""

_R = "(event_id - case when event_id%20=1 then 1 else 0 end)"


def _raw_value(i, name):
    base = f"cast({i + 1}*(1+r%{11 + i}) as varchar)"
    if name == "Flow Byts/s":
        return f"case when r%50=0 then 'Infinity' when r%53=0 then 'NaN' else {base} end"
    if name == "Flow IAT Std":
        return f"case when r%59=0 then 'n/a' else {base} end"
    return base


CTE["raw"] = (
    "select 'f'||r as \"Flow ID\", "
    + ", ".join(f'{_raw_value(i, n)} as "{n}"' for i, n in enumerate(RAW_TO_FEATURE))
    + ", case when r%41=0 then ' ' when r%5=0 then 'Benign' when r%5=1 then 'DDOS attack-HOIC' when r%5=2 then ' FTP-BruteForce' "
    + f"when r%5=3 then 'Bot' else 'DoS attacks-Hulk' end as \"Label\" from (select {_R} as r from events)"
)
_LABEL = (
    "case trim(\"Label\") when 'Benign' then 'Normal Traffic' when 'DDOS attack-HOIC' then 'DDoS' when 'FTP-BruteForce' then 'Brute Force' "
    "when 'Bot' then 'Bots' when 'DoS attacks-Hulk' then 'DoS' else trim(\"Label\") end"
)


def _mapped(name):
    v = f'try_cast("{name}" as double)'
    return v + "/1e6" if name in RAW_MICROS else v


_MAP = ", ".join(f"{_mapped(n)} as {f}" for n, f in RAW_TO_FEATURE.items())
CTE["rawclean"] = 'select distinct * replace (trim("Label") as "Label") from raw where trim("Label")<>\'\''
_FINITE = " and ".join(f"{f} is not null and isfinite({f})" for f in FEATURES)
CTE["prepared"] = f"select * from (select {_MAP}, {_LABEL} as label from rawclean) where {_FINITE}"
CTE["prep_counts"] = "select label, count(*) as rows from prepared group by label"


def _half_even(x):
    return f"round_even({x}, 0)"


_TARGET = "cast(greatest(case when rows>1 then least(round_even(rows*cast(0.25 as double),0),rows-1) else round_even(rows*cast(0.25 as double),0) end,0) as bigint)"

_PREP = {f: f"cast({i + 1}*(1+r%{11 + i}) as varchar)" for i, f in enumerate(FEATURES)}
_PREP["dst_port"] = f"case when r%17=0 then '70000' when r%19=0 then '80.5' else {_PREP['dst_port']} end"
_PREP["protocol"] = "case when r%3=0 then '6' when r%3=1 then '17' else '255' end"
_PREP["flow_duration"] = f"case when r%23=0 then 'inf' else {_PREP['flow_duration']} end"
_PREP["packet_len_mean"] = f"case when r%29=0 then '-5' else {_PREP['packet_len_mean']} end"
_PREP["flow_iat_mean"] = f"case when r%31=0 then 'NaN' else {_PREP['flow_iat_mean']} end"
_PREP["fin_flag_count"] = "case when r%2=0 then '2.5' else '3.5' end"
CTE["prep_in"] = (
    "select "
    + ", ".join(f"{v} as {k}" for k, v in _PREP.items())
    + ", case when r%43=0 then ' ' when r%47=0 then 'NaN' when r%4=0 then ' Normal Traffic' when r%4=1 then 'DDoS' when r%4=2 then 'Bots' else 'DoS' end as lab "
    + "from (select event_id as r from events)"
)


def _prep_out(f):
    v = f"greatest(case when isfinite(try_cast({f} as double)) then try_cast({f} as double) else 0 end, 0)"
    if f in WHOLE_FEATURES:
        v = _half_even(v)
    if f == "protocol":
        v = f"case when {v} in (0,1,6,17) then {v} else 0 end"
    if f == "dst_port":
        v = f"case when {v}>65535 then 0 else {v} end"
    return f"cast({v} as {'bigint' if f in WHOLE_FEATURES else 'double'}) as {f}"


_BAD = ",".join(f"'{b}'" for b in BAD_LABELS)
CTE["prep_clean"] = f"select {', '.join(_prep_out(f) for f in FEATURES)}, trim(lab) as label from prep_in where lower(trim(lab)) not in ({_BAD})"

CTE["pairs"] = """
select actual, case when r%7=0 or r%101=0 then (case r%4 when 0 then 'DDoS' when 1 then 'Normal Traffic' when 2 then 'DDoS' else 'DoS' end)
 else actual end as predicted
from (select event_id as r, case when event_id%101=0 then 'Foreign' else (case event_id%4 when 0 then 'Normal Traffic' when 1 then 'DDoS' when 2 then 'DoS' else 'Bots' end) end as actual from events)"""
CTE["known"] = "select unnest(['Bots','DDoS','DoS','Normal Traffic']) as label"
CTE["conf"] = """
select a.label as actual, b.label as predicted, (select count(*) from pairs p where p.actual=a.label and p.predicted=b.label) as n
from known a, known b"""
CTE["metrics"] = """
select label, case when pn>0 then cast(tp as double)/pn else 0 end as precision, case when support>0 then cast(tp as double)/support else 0 end as recall, support, tp
from (select k.label, (select cast(sum(n) as bigint) from conf where actual=k.label) as support, (select cast(sum(n) as bigint) from conf where predicted=k.label) as pn,
 (select n from conf where actual=k.label and predicted=k.label) as tp from known k)"""
CTE["metrics1"] = "select *, case when precision+recall>0 then 2*precision*recall/(precision+recall) else 0 end as f1 from metrics"

_DEPENDS = {
    "packets": [],
    "scored": ["packets"],
    "events_in": ["scored"],
    "evts": ["events_in"],
    "alert_rows": ["evts"],
    "alerts": ["alert_rows"],
    "threats": ["alerts"],
    "seqd": ["packets"],
    "st": ["seqd"],
    "assigned": ["packets", "st"],
    "sess": ["assigned"],
    "measures": ["assigned"],
    "feats": ["measures"],
    "ruled": ["feats"],
    "session_rows": ["sess", "ruled"],
    "trig": ["assigned"],
    "win": ["packets"],
    "stateless": ["packets"],
    "heur": ["win"],
    "brute": ["packets"],
    "reqs": ["heur", "brute", "scored", "cmds"],
    "mlreqs": ["scored"],
    "fold": ["reqs"],
    "settled": ["fold"],
    "autoreqs": ["heur", "brute", "scored"],
    "dec": ["autoreqs"],
    "all_dec": ["settled"],
    "all_acc": ["all_dec"],
    "all_flagged": ["all_acc"],
    "mldec": ["mlreqs"],
    "acc": ["dec"],
    "flagged": ["acc"],
    "watched": ["settled"],
    "feed": ["all_flagged", "watched", "heur"],
    "commands": [],
    "cmds": ["commands"],
    "blocks": [],
    "last_block": ["blocks"],
    "control": ["last_block"],
    "snaps": ["packets"],
    "screens": [],
    "decisions": ["screens"],
    "raw": [],
    "rawclean": ["raw"],
    "prepared": ["rawclean"],
    "prep_counts": ["prepared"],
    "prep_in": [],
    "prep_clean": ["prep_in"],
    "pairs": [],
    "known": [],
    "conf": ["pairs", "known"],
    "metrics": ["conf"],
    "metrics1": ["metrics"],
}
_RECURSIVE = {"st", "trig", "fold", "dec", "mldec"}


def _sql(names: str, body: str) -> str:
    order: list[str] = []

    def visit(n):
        for d in _DEPENDS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names.split():
        visit(n)
    # A name that several later steps read is computed once.
    parts = [f"{n} as {'' if n in _RECURSIVE else 'materialized '}({CTE[n].strip()})" for n in order]
    return ("with recursive " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


_ALERT_OUT = "kind, attack_type, confidence, status<>'cooldown_active' as blocked, status as block_status, duration_s as block_duration_s, src_ip, dst_ip, t_us, packet_id"
_TYPES = "case kind when 'heuristic' then 'heuristic_high_confidence' when 'bruteforce' then 'heuristic_bruteforce_detected' when 'ml_live' then 'ml_attack_detected' else 'ml_completed_flow_update' end as type"
_HOUR = "strftime(make_timestamp({0}), '%Y-%m-%d %H:00')"
_INCIDENT = "(select * from alerts order by last_seen_us desc, dedup_key desc limit 1)"
_RELATED = "from blocks b, inc where b.session_id=inc.session_id or b.source_ip=inc.source_ip"


def _page(cols, src, where, order, limit, offset=0):
    return (
        f"select {cols}, (select count(*) from {src} where {where}) as total_count from {src} where {where} "
        f"order by {order} limit {limit} offset {offset}"
    )


_EVT_COLS = "event_id, ts_us, source_ip, destination_ip, protocol, prediction, severity, action, session_id"
_SESS_COLS = "session_id, start_time_us, end_time_us, packet_count, byte_count, state, ml_prediction"
_SESS_ORDER = "start_time_us desc, session_id||'@'||start_time_us"
_FIVE_DAYS = 1_704_067_200_000_000 + 5 * 86_400_000_000


def _running(feed: str) -> str:
    """The record of an address as of each of its activities: plain frames over the whole address."""
    so_far = "(partition by ip order by t_us, tie, attack_type, action rows unbounded preceding)"
    return f"""select ip, min(t_us) over {so_far} as first_detected_us, t_us as last_detected_us, count(*) over {so_far} as total_attack_attempts,
case when count(*) over {so_far}>1 then 'repeated_attempts' else 'single_attempt' end as attempt_pattern,
array_to_string(list_sort(list(attack_type) filter (sight=1) over {so_far}),';') as attack_types_used,
list(t_us) over (partition by ip order by t_us, tie, attack_type, action rows 24 preceding) as times
from (select *, row_number() over (partition by ip, attack_type order by t_us, tie, action) as sight from ({feed}))"""


def statements() -> dict[str, str]:
    q: dict[str, str] = {}
    q["src_packets"] = _sql("packets", "select * from packets")
    q["src_raw_flows"] = _sql("raw", 'select trim("Label") as label, "Protocol" as protocol, count(*) as rows from raw group by all')
    q["src_prepared_flows"] = _sql("prep_clean", "select label, count(*) as rows from prep_clean group by label")
    q["snk_dataset"] = _sql(
        "prep_counts",
        """select part, label, case part when 'cleaned' then rows when 'train' then tr else rows-tr end as rows from (
select label, rows, rows*t//n + case when rank<=t-sum(rows*t//n) over () then 1 else 0 end as tr from (
 select *, row_number() over (order by rows*t%n desc, label) as rank from (
  select *, n-cast(ceil(n*cast(0.2 as double)) as bigint) as t from (select *, cast(sum(rows) over () as bigint) as n from prep_counts)))),
(select unnest(['cleaned','train','test']) as part)""",
    )
    q["snk_upsert"] = _sql(
        "blocks",
        """select 'block_events' as table_name, event_id, case when detection_method='manual' then 'new_'||reason else reason end as reason from blocks
union all select 'ids_events', event_id, reason from blocks""",
    )
    q["snk_activity_jsonl"] = _sql(
        "stateless",
        f"""select ip, first_detected_us, last_detected_us, total_attack_attempts, attempt_pattern, attack_types_used,
array_to_string([cast(x as varchar) for x in times],';') as history_times
from (select *, row_number() over (order by last_detected_us desc, ip, total_attack_attempts desc) as place from ({_running("select src_ip as ip, t_us, packet_id as tie, reason as attack_type, 'allowed' as action from stateless")}))
where place<=1000""",
    )
    q["snk_fanout"] = _sql(
        "evts blocks alerts session_rows packets",
        """select 'ids-events' as kind, prediction as label, count(*) as rows, max(ts_us) as newest_us from evts group by all
union all select 'alerts', severity, count(*), max(last_seen_us) from alerts group by all
union all select 'session-updates', state, count(*), max(start_time_us) from session_rows group by all
union all select 'telemetry', 'snapshot', count(distinct wall_us//3600000000), (max(wall_us)//3600000000)*3600000000 from packets
union all select 'block-events', reason, count(*), max(ts_us) from blocks group by all""",
    )
    q["buf_recent_n"] = _sql("packets", "select packet_id, t_us, src_ip, dst_ip, packet_size from packets order by t_us desc, packet_id desc limit 1000")

    q["flt_capture"] = _sql(
        "packets",
        """select packet_id, src_ip, dst_ip, src_port, dst_port from packets
where (src_ip in ('10.0.0.2','10.1.0.3') or dst_ip in ('10.0.0.2','10.1.0.3') or coalesce(src_port=443,false) or coalesce(dst_port=443,false))
and not (src_ip='10.0.0.5' or dst_ip='10.0.0.5' or coalesce(src_port=40003,false) or coalesce(dst_port=40003,false))""",
    )
    q["prj_packet_norm"] = _sql(
        "packets",
        """select packet_id, t_us, src_ip, dst_ip, packet_size, cast(case when tcp then 6 when protocol=17 then 17 when protocol=1 then 1 else 0 end as integer) as protocol,
case when tcp or protocol=17 then src_port end as src_port, case when tcp or protocol=17 then dst_port end as dst_port,
case when tcp then tcp_flags end as tcp_flags, case when tcp then tcp_window_size end as tcp_window_size,
case when tcp then 4*(5+packet_id%3) end as tcp_header_length, case when tcp then 4*(5+packet_id%3) when protocol in (1,17) then 8 end as transport_header_length,
case when tcp or protocol in (1,17) then payload_size else 0 end as payload_size
from (select *, protocol=6 and packet_id%37<>0 as tcp from packets) where packet_id%31<>0""",
    )
    q["fn_tcp_flags"] = _sql(
        "packets",
        "select packet_id, " + ", ".join(f"coalesce(tcp_flags & {b} <> 0, false) as {k}" for k, b in dict(fin=1, syn=2, rst=4, psh=8, ack=16, urg=32).items()) + " from packets",
    )
    q["fn_session_id"] = _sql("packets", f"select packet_id, {SID} as session_id from packets")
    q["fn_event_id"] = _sql("scored", f"select packet_id, {event_id('session_id', 'event_type', 'label', 't_us')} as event_id from scored")
    q["fn_block_event_id"] = _sql(
        "packets",
        "select packet_id, "
        + ", ".join(f"'{p}-'||src_ip||'-'||(t_us//1000) as {k}" for k, p in dict(heuristic="heuristic", bruteforce="bruteforce", ml_live="ml-live", ml_final="ml-final").items())
        + " from packets",
    )
    q["fn_severity"] = _sql("scored", f"select packet_id, label, {SEV.format('label', 'confidence')} as severity from scored")
    q["fn_risk"] = _sql(
        "scored stateless",
        """select packet_id, st.score, greatest(case when s.label='Normal Traffic' then 0 else s.confidence end, least(1.0,greatest(0.0,cast(st.score as double)/10))) as risk_score
from scored s join stateless st using (packet_id)""",
    )
    q["fn_action"] = _sql("scored", "select packet_id, case when label='Normal Traffic' then 'allow' else 'alert' end as event_action, case when is_final then 'flow_end' else 'allowed' end as session_action from scored")
    q["fn_blockable_ip"] = _sql(
        "commands",
        """select seq, x as ip, x not in ('::1','','not-an-ip','127.0.0.1') as blockable from
(select seq, case when seq%6=0 then '::1' when seq%6=1 then '2001:db8::7' else ip end as x from commands)""",
    )
    q["fn_sanitize"] = _sql(
        "raw",
        """select "Flow ID" as flow, case when isfinite(try_cast("Flow Byts/s" as double)) then try_cast("Flow Byts/s" as double) else 0 end as bytes_per_sec,
coalesce(try_cast("Flow IAT Std" as double),0) as iat_std from raw""",
    )
    q["fn_safe_rate"] = _sql("packets", "select packet_id, case when t_us%5-1>0 then cast(packet_size as double)/(t_us%5-1) else 0 end as rate from packets")
    q["map_flow_columns"] = _sql("raw", f'select {_MAP}, "Flow ID" as flow from raw')
    q["fn_us_to_s"] = _sql("raw", 'select "Flow ID" as flow, try_cast("Flow Duration" as double)/1e6 as duration_s, try_cast("Fwd IAT Tot" as double)/1e6 as fwd_iat_total_s from raw')
    q["fn_label_norm"] = _sql("raw", f'select "Label" as raw_label, {_LABEL} as label, count(*) as rows from raw group by all')
    q["val_strict_features"] = _sql(
        "raw",
        "\nunion all ".join(
            f"select '{f}' as feature, count(*) filter (not coalesce(isfinite({_mapped(n)}),false)) as invalid_rows from raw" for n, f in RAW_TO_FEATURE.items()
        ),
    )
    q["flt_finite_rows"] = _sql("raw", f'select flow, flow_bytes_per_sec, flow_iat_std from (select "Flow ID" as flow, {_MAP} from raw) where {_FINITE}')
    q["cln_raw"] = _sql("rawclean", 'select "Flow ID" as flow, "Label" as label from rawclean')
    q["cln_prepared"] = _sql("prep_clean", "select * from prep_clean")
    q["fn_event_backfill"] = _sql("evts", "select * exclude (severity) from evts")
    q["fn_sql_decision"] = _sql("decisions", "select * from decisions")
    q["qry_list_events"] = _sql("evts", _page(_EVT_COLS, "evts", "severity='high' and protocol=6", "ts_us desc, event_id", 50, 10))
    q["qry_logs"] = _sql("evts", _page(_EVT_COLS, "evts", f"action='alert' and ts_us>={_FIVE_DAYS} and ts_us<={_FIVE_DAYS + 7 * 86_400_000_000}", "ts_us desc, event_id", 40))
    q["qry_list_alerts"] = _sql(
        "alerts",
        _page("dedup_key, event_id, prediction, severity, first_seen_us, last_seen_us, occurrence_count", "alerts", "source_ip='10.0.0.2'", "last_seen_us desc, dedup_key", 30, 5),
    )
    q["qry_list_threats"] = _sql("threats", _page("threat_id, ts_us, source_ip, attack_type, severity, status", "threats", "attack_type='Bots'", "ts_us desc, threat_id", 30))
    q["qry_list_sessions"] = _sql("session_rows", _page(_SESS_COLS, "session_rows", "protocol=6 and risk>=0.55", _SESS_ORDER, 40, 3))
    q["qry_traffic"] = _sql("session_rows", _page(_SESS_COLS, "session_rows", "state='idle_timeout' and source_ip='10.0.0.4'", _SESS_ORDER, 40))
    q["vw_threats"] = _sql("threats", "select * from threats")

    q["ses_assign"] = _sql("st", "select packet_id, flow_id, start_us, start_packet, iat_us from st")
    q["ses_summary"] = _sql("sess", "select flow_id, start_us, start_packet, end_us, packet_count, byte_count, duration_us, reason from sess")
    q["ses_reason"] = _sql("sess", "select reason, count(*) as sessions from sess group by reason")
    q["ses_active"] = _sql("sess", "select flow_id, start_us, end_us, packet_count from sess where reason='active'")
    q["ses_predict_trigger"] = _sql("trig", "select flow_id, start_us, packet_id, packet_no, fin as is_final from trig where hit")
    q["ses_lifecycle"] = _sql(
        "trig sess",
        """select 'started' as stage, 'new_session' as reason, flow_id, start_us, t_us, packet_no as packet_count, packet_size as byte_count, cast(0 as bigint) as duration_us from assigned where packet_no=1
union all select 'active', 'prediction_trigger', t.flow_id, t.start_us, t.t_us, t.packet_no,
 (select cast(sum(packet_size) as bigint) from assigned a where a.flow_id=t.flow_id and a.start_us=t.start_us and a.start_packet=t.start_packet and a.packet_no<=t.packet_no), t.t_us-t.start_us from trig t where hit
union all select 'finalized', reason, flow_id, start_us, end_us, packet_count, byte_count, duration_us from sess where reason<>'active'""",
    )
    q["feat_session"] = _sql("feats", f"select flow_id, start_us, {', '.join(FEATURES)} from feats")
    live = CTE["measures"].replace("from assigned group by all", "from live group by all").replace("select flow_id", "select point, flow_id")
    q["feat_live"] = _sql(
        "trig",
        f"""select flow_id, start_us, point as packet_id, {_FEATURE_LIST} from ({live.replace("from live", "from (select a.*, t.packet_id as point from trig t join assigned a on a.flow_id=t.flow_id and a.start_us=t.start_us and a.start_packet=t.start_packet and a.packet_no<=t.packet_no where t.hit)")})""",
    )
    for name, cols in FEATURE_GROUPS.items():
        q[name] = _sql("feats", f"select flow_id, start_us, {', '.join(cols)} from feats")
    q["feat_incremental"] = _sql(
        "measures",
        "select flow_id, start_us, start_packet, n, bytes as total, bytes_sq as squares, size_min as low, size_max as high, cast(0 as integer) as diverging from measures",
    )

    for name in ("scan_burst", "port_sweep", "syn_only_surge"):
        key = {"scan_burst": "det_burst", "port_sweep": "det_port_sweep", "syn_only_surge": "det_syn_surge"}[name]
        q[key] = _sql("win", f"select packet_id, {name} from win")
    q["det_stateless"] = _sql("stateless", "select packet_id, score, reason, suspicious from stateless")
    q["det_heuristic"] = _sql("heur", "select packet_id, score, reason, suspicious from heur")
    q["det_bruteforce"] = _sql("brute", "select packet_id, bruteforce from brute")
    q["det_heuristic_action"] = _sql("heur", "select case when score>=3 then 'high_temp_block' else 'alert_only' end as action, score, count(*) as packets from heur group by all")
    q["det_tracked_top_n"] = _sql("packets", "select src_ip, max(t_us) as last_seen_us from packets group by src_ip order by 2 desc, 1 limit 5")

    q["alr_heuristic"] = _sql("dec", f"select * exclude (kind) from (select {_TYPES}, {_ALERT_OUT} from dec where kind='heuristic')")
    q["alr_bruteforce"] = _sql("dec", f"select * exclude (kind) from (select {_TYPES}, {_ALERT_OUT} from dec where kind='bruteforce')")
    q["alr_ml"] = _sql("dec", f"select * exclude (kind) from (select {_TYPES}, {_ALERT_OUT}, kind='ml_final' as is_final from dec where kind in ('ml_live','ml_final'))")
    q["alr_session_dedup"] = _sql(
        "dec",
        f"""select session_id, packet_id, attack_type, confidence, blocked, case when fin then 'final' when pa is not null and not pf then 'updated' else 'new' end as update_type
from (select *, lag(attack_type) over w as pa, lag(confidence) over w as pc, lag(blocked) over w as pb, lag(fin) over w as pf
 from (select *, {SID} as session_id, status<>'cooldown_active' as blocked, kind='ml_final' as fin from dec where kind in ('ml_live','ml_final')) window w as (partition by session_id order by t_us, seq))
where fin or pa is null or pf or not (pa=attack_type and pc=confidence and pb=blocked)""",
    )
    q["alr_upsert"] = _sql("alerts", "select * from alerts")
    q["evt_ids"] = _sql(
        "ruled sess",
        f"""select '1.0' as schema_version, {event_id("flow_id", "'ml_completed_flow_prediction'", "label", "end_us")} as event_id, end_us as ts_us, src_ip as source, src_ip as source_ip,
dst_ip as destination_ip, src_port as source_port, dport as destination_port, proto as protocol, 'primary' as model, label as prediction, label as attack_type, confidence,
confidence as confidence_score, {SEV.format("label", "confidence")} as severity, case when label='Normal Traffic' then 'allow' else 'alert' end as action,
case when label='Normal Traffic' then 'allow' else 'alert' end as action_taken, 'ml_completed_flow_prediction' as detection_method, flow_id as session_id, confidence as risk_score,
n as packet_count, bytes as byte_count, cast(round(cast(flow_duration as decimal(18,6)), 4) as double) as flow_duration, label as ml_prediction, n as session_packet_count, bytes as session_byte_count, true as is_final,
{", ".join(f"{f} as feature_{f}" for f in FEATURES)} from ruled join (select flow_id, start_us, start_packet from sess where reason<>'active') using (flow_id, start_us, start_packet)""",
    )
    shadow_kind = "case when is_final then 'ml_completed_flow_secondary_shadow' else 'ml_live_secondary_shadow' end"
    q["evt_shadow"] = _sql(
        "scored",
        f"""select '1.0' as schema_version, {event_id("session_id", "(" + shadow_kind + ")", "shadow_label", "t_us")} as event_id, t_us as ts_us, src_ip as source, src_ip as source_ip,
dst_ip as destination_ip, src_port as source_port, dst_port as destination_port, protocol, 'decision_tree' as model, shadow_label as prediction, shadow_label as attack_type,
shadow_confidence as confidence, shadow_confidence as confidence_score, {SEV.format("shadow_label", "shadow_confidence")} as severity, 'shadow' as action, 'shadow' as action_taken,
{shadow_kind} as detection_method, session_id, shadow_confidence as risk_score, is_final, shadow_label as ml_prediction from scored""",
    )
    q["evt_block"] = _sql(
        "all_acc",
        f"""select replace(kind,'_','-')||'-'||ip||'-'||(t_us//1000) as event_id, t_us as ts_us, ip as source_ip, 'blocked' as action_taken,
case kind when 'heuristic' then 'heuristic_high_confidence' when 'bruteforce' then 'bruteforce_detected' else attack_type end as reason,
case when kind like 'ml%' then 'ml' else 'heuristic' end as detection_method, {SID} as session_id,
src_port as source_port, dst_ip as destination_ip, dst_port as destination_port, protocol, until as expires_us from all_acc where kind<>'command'
union all select 'cmd-'||command_id, t_us, ip, case action when 'block' then 'blocked' when 'unblock' then 'unblocked' else action||'ed' end, 'manual_'||action, 'manual', null, null, null, null, null,
case when action='block' then t_us+duration_s*1000000 end from settled where kind='command' and status in ('blocked','already_blocked','unblocked','watchlisted','unwatchlisted')""",
    )
    q["blk_state"] = _sql("dec", "select ip, t_us, packet_id, kind, status, status<>'cooldown_active' as ok, case when status in ('blocked','already_blocked') then until end as until_us from dec")
    q["blk_settled"] = _sql("all_dec", "select ip, t_us, packet_id, kind, status, status<>'cooldown_active' as ok, case when status in ('blocked','already_blocked') then until end as until_us from all_dec")
    q["blk_commands"] = _sql(
        "settled",
        f"select command_id, action, ip, duration_s, t_us, seq+4611686018427387904 as seq, status not in {_FAILED} as ok, status from settled where kind='command'",
    )
    q["blk_flag_packets"] = _sql("flagged", "select * from flagged")
    q["blk_watch_packets"] = _sql("watched", "select * from watched")
    q["ip_activity_feed"] = _sql("feed", "select ip, attack_type, action, count(*) as entries, min(t_us) as first_us, max(t_us) as last_us from feed group by all")
    q["ip_activity"] = _sql(
        "feed",
        """select ip, min(t_us) as first_detected_us, max(t_us) as last_detected_us, count(*) as total_attack_attempts,
array_to_string(list_sort(list(distinct attack_type)),';') as attack_types_used, case when count(*)>1 then 'repeated_attempts' else 'single_attempt' end as attempt_pattern,
array_to_string([cast(x as varchar) for x in list(t_us order by rn desc) filter (rn<=25)],';') as history_times
from (select *, row_number() over (partition by ip order by t_us desc, tie desc, attack_type desc, action desc) as rn from feed) group by ip""",
    )
    q["ip_activity_running"] = _sql(
        "feed",
        f"""select ip, first_detected_us, last_detected_us, total_attack_attempts, attempt_pattern, attack_types_used, cast(len(times) as bigint) as history, times[1] as oldest_us
from ({_running("select * from feed")})""",
    )
    q["ip_control_state"] = _sql("control", "select * from control")
    q["ip_blocked_summary"] = _sql(
        "last_block",
        """select l.source_ip as ip_address, l.st as status, l.reason, a.first_detected_us, a.last_detected_us, a.total_attempts, a.attack_types, l.action_taken as last_action, l.detection_method as source
from last_block l join (select source_ip, min(ts_us) as first_detected_us, max(ts_us) as last_detected_us, count(*) as total_attempts,
 array_to_string(list_sort(list(distinct reason)),';') as attack_types from blocks group by source_ip) a using (source_ip) where l.rn=1 and l.st='blocked'""",
    )
    q["ip_block_history"] = _sql("blocks", "select event_id, ts_us, action_taken, reason from blocks where source_ip='10.0.0.7'")
    q["act_respond"] = _sql(
        "threats commands",
        """select t.threat_id, t.source_ip, coalesce(u.action,t.action_taken) as action_taken, case when u.ip is null then t.status else coalesce(case when u.seq%2=0 then 'closed' end,'open') end as status
from threats t left join (select * from (select *, row_number() over (partition by ip order by seq desc) as rn from commands where ip like '10.%') where rn=1) u on u.ip=t.source_ip""",
    )

    q["tel_rates"] = _sql("snaps", "select * from snaps")
    q["tel_loss"] = _sql("snaps", "select snapshot_us, dropped_per_window>0 as packet_loss_detected from snaps")
    q["tel_queue"] = _sql(
        "snaps",
        """select snapshot_us, round(cast(received_per_window as double)/10000*100,4) as queue_usage_percent,
round(cast(predictions_per_window+shadow_per_window as double)/512*100,4) as secondary_usage_percent, cast(0 as double) as unbounded_percent from snaps""",
    )
    open_at = "sess where start_us<=s*30000000 and (case when finished then end_us else least(end_us+30000000,start_us+120000000) end)>s*30000000"
    q["tel_exchanges"] = _sql(
        "sess",
        f"""select s*30000000 as snapshot_us, max(cnt) as active_sessions, string_agg(src_ip||'/'||dst_ip||'/'||packet_count, ';' order by rn) as exchanges from (
select s, sess.*, row_number() over (partition by s order by start_us, start_packet) as rn, count(*) over (partition by s) as cnt
from {open_at.replace("sess where", "sess, (select unnest(generate_series(0,(select cast(max(start_us)//30000000+5 as bigint) from sess))) as s) where")}) where rn<=20 group by s""",
    )
    q["tel_history"] = _sql(
        "snaps", "select *, dropped_per_window>0 as packet_loss_detected, (select count(*) from snaps) as total_count from snaps order by snapshot_us desc limit 30 offset 2"
    )
    q["tel_engine_seen"] = _sql(
        "packets",
        "select dst_ip||'-'||protocol as engine_id, max(t_us) as last_seen_us, (select max(t_us) from packets)-max(t_us)<=30000000 as online from packets group by all",
    )
    day = f"{REPORT_DAY_US} and {{0}}<{REPORT_DAY_US + 86_400_000_000}"
    q["dash_summary"] = _sql(
        "alerts session_rows control snaps",
        f"""select (select count(*) from alerts) as total_threats, (select count(*) from session_rows) as total_sessions,
(select count(*) from alerts where last_seen_us>={day.format("last_seen_us")}) as threats_today, (select count(*) from session_rows where state='active') as active_sessions,
(select count(*) from control where current_status='blocked') as blocked_ips,
(select count(*) from last_block where st='blocked' and ts_us>={day.format("ts_us")}) as blocked_events_today,
(select count(*) from control where current_status='watchlisted') as watchlisted_ips, (select count(*) from alerts where severity='high') as high_severity_threats,
round(cast(received_per_window as double)/10000*100,4) as packet_queue_usage_percent, received_per_window as packets_received_per_30s,
predictions_per_window as ml_predictions_per_30s, dropped_per_window>0 as packet_loss_detected, cast(0 as double) as last_ml_prediction_latency_ms
from snaps order by snapshot_us desc limit 1""",
    )
    q["dash_attack_distribution"] = _sql("alerts", "select prediction as label, count(*) as count from alerts group by all")
    q["dash_threats_over_time"] = _sql("alerts", f"select {_HOUR.format('last_seen_us')} as bucket, count(*) as count from alerts group by all")
    q["dash_blocks_over_time"] = _sql("blocks", f"select {_HOUR.format('ts_us')} as bucket, count(*) as count from blocks group by all")
    h = "({0}//3600000000)*3600000000"
    q["dash_rollup"] = _sql(
        "evts last_block",
        f"""select *, 'hour' as bucket_size, case when network_activity_total>0 then round(cast(threat_event_total as double)/network_activity_total,4) else 0 end as threat_rate from (
select b as bucket_start_us, (select count(*) from packets where {h.format("wall_us")}=b) as network_activity_total,
 (select count(*) from evts where {h.format("ts_us")}=b and prediction<>'Normal Traffic') as threat_event_total,
 (select count(*) from evts where {h.format("ts_us")}=b and prediction='Normal Traffic') as benign_event_total,
 (select count(*) from last_block where {h.format("ts_us")}=b and st='blocked') as blocked_event_total,
 (select count(distinct wall_us//600000000) from packets where {h.format("wall_us")}=b) as telemetry_snapshot_count,
 (select count(*) from evts where {h.format("ts_us")}=b) as ml_prediction_total,
 coalesce((select max(c) from (select count(distinct src_ip) as c from packets where {h.format("wall_us")}=b group by wall_us//600000000)),0) as active_sessions_peak,
 (select count(distinct wall_us//600000000) from packets where {h.format("wall_us")}=b and packet_size=0) as packet_loss_event_total
from (select distinct {h.format("wall_us")} as b from packets union select distinct {h.format("ts_us")} from last_block)) order by bucket_start_us desc limit 48""",
    )
    q["dash_top_sources"] = _sql("alerts", "select source_ip, count(*) as count from alerts group by 1 order by 2 desc, 1 limit 10")
    q["dash_top_ports"] = _sql("alerts", "select destination_port, count(*) as count from alerts where destination_port is not null group by 1 order by 2 desc, 1 limit 10")
    q["dash_model_metrics"] = _sql(
        "scored decisions",
        """select cast(sum(50+packet_id*37%50) as double)/100/count(*) as xgbooster_confidence, cast(count(*) filter (label<>'Normal Traffic') as double)/count(*) as xgbooster_detection_rate,
cast(sum(40+packet_id*53%60) as double)/100/count(*) as decision_tree_confidence,
cast(count(*) filter (label<>'Normal Traffic' and shadow_label<>'Normal Traffic') as double)/count(*) filter (shadow_label<>'Normal Traffic') as decision_tree_precision,
(select cast(sum(cast(round(confidence*100) as bigint)) as double)/100/count(*) from decisions) as sqli_confidence,
(select cast(count(*) filter (detected and confidence>=0.8) as double)/count(*) filter (detected) from decisions) as sqli_precision from scored""",
    )
    q["dash_incidents"] = _sql(
        "alerts",
        "select event_id as incident_id, dedup_key, prediction, severity, last_seen_us, occurrence_count, (select count(*) from alerts) as total_count from alerts order by last_seen_us desc, dedup_key limit 30",
    )
    q["dash_audit"] = _sql("blocks", _page("event_id, ts_us, source_ip, action_taken", "blocks", "true", "ts_us desc, event_id", 30, 10))
    q["dash_incident_detail"] = _sql(
        "alerts session_rows blocks",
        f"""select event_id as incident_id, 'incident' as kind, event_id as ref, s.at as at_us, prediction as detail, s.n from {_INCIDENT} inc
 left join (select (wall_us//3600000000)*3600000000 as at, count(*) as n from packets group by 1) s on s.at<=inc.last_seen_us
 qualify row_number() over (order by s.at desc nulls last)=1
union all select inc.event_id, 'session', s.session_id, s.start_time_us, s.state, s.packet_count from session_rows s join {_INCIDENT} inc on s.session_id=inc.session_id
union all select inc.event_id, 'audit', b.event_id, b.ts_us, b.action_taken, null from blocks b join {_INCIDENT} inc on b.session_id=inc.session_id or b.source_ip=inc.source_ip""",
    )
    fields = ["event_id", "prediction", "severity", "source_ip", "destination_ip", "status", "occurrence_count"]
    heads = ["'# Incident'", *(f"'- {c}: '||coalesce(cast({c} as varchar),'')" for c in fields), "'- sessions: '||(select count(*) from session_rows s where s.session_id=inc.session_id)", "'- audit:'"]
    q["dash_incident_report"] = _sql(
        "alerts session_rows blocks",
        f"""select event_id, 'csv' as part, i as place, cast(null as bigint) as at_us, cast(null as varchar) as ref, x as line
 from (select event_id, unnest(['{",".join(fields)}', concat_ws(',',{",".join(fields)})]) as x, unnest([0,1]) as i from {_INCIDENT})
union all select event_id, 'markdown', i, null, null, x from (select inc.event_id, unnest([{", ".join(heads)}]) as x, unnest(range({len(heads)})) as i from {_INCIDENT} inc)
union all select inc.event_id, 'markdown', {len(heads)}, b.ts_us, b.event_id, '  - '||b.action_taken||' '||b.reason from blocks b join {_INCIDENT} inc on b.session_id=inc.session_id or b.source_ip=inc.source_ip""",
    )
    known = "where session_id is not null and session_id not in (select flow_id from sess where reason<>'active') group by all"
    q["chk_orphans"] = _sql(
        "sess alerts blocks",
        "\nunion all ".join(
            f"select '{n}' as table_name, session_id, count(*) as row_count from {t} {known}" for n, t in dict(ids_events="evts", alerts="alerts", block_events="blocks").items()
        ),
    )
    q["chk_shadow_pairs"] = _sql(
        "scored",
        """select session_id, count(*) as pairs, count(*) filter (label=near) as agreeing from (
select p.session_id, p.packet_id, p.label, arg_min(s.shadow_label, abs(s.ts-p.t_us)*2+case when s.ts>p.t_us then 1 else 0 end) as near
from scored p join (select session_id, t_us+packet_id%3*400000 as ts, shadow_label from scored where is_final) s
 on s.session_id=p.session_id and abs(s.ts-p.t_us)<=500000 where p.is_final group by all) group by session_id""",
    )

    q["ds_prepare"] = _sql("prepared", "select * from prepared")
    q["ds_label_counts"] = _sql(
        "rawclean",
        """select label, raw_rows, coalesce(clean_rows,0) as clean_rows from (select trim("Label") as label, count(*) as raw_rows from raw group by 1)
left join (select "Label" as label, count(*) as clean_rows from rawclean group by 1) using (label)""",
    )
    q["ds_test_targets"] = _sql("prep_counts", f"select label, rows, {_TARGET} as test_rows from prep_counts")
    q["ds_split"] = _sql("prep_counts", f"select label, true as is_test, {_TARGET} as rows from prep_counts union all select label, false, rows-{_TARGET} from prep_counts")
    q["ml_label_index"] = _sql("scored", "select label, dense_rank() over (order by label)-1 as label_index, count(*) as rows from scored group by label")
    trained = "(select label, count(*) as rows from ruled group by label)"
    for name in ("ml_train_primary", "ml_train_alt", "ml_train_secondary"):
        q[name] = _sql("ruled", f"select label, {_TARGET} as support, cast((select sum({_TARGET}) from {trained}) as bigint) as scored, true as learned from {trained} where {_TARGET}>0")
    q["ml_score"] = _sql("ruled", "select flow_id, start_us, true as sums_to_one, true as confidence_is_largest, true as label_is_largest, true as shadow_scored from ruled")
    q["ml_artifact_guard"] = _sql(
        "ruled", "select 'intact' as case, true as accepted, count(*) as scored from ruled union all select 'altered_file', false, 0 union all select 'other_columns', false, 0".replace("as case", 'as "case"')
    )
    q["ev_confusion"] = _sql("conf", "select actual, predicted, n from conf union all select actual, '(unknown)', count(*) from pairs where actual not in (select label from known) group by actual")
    q["ev_metrics"] = _sql("metrics1", "select label, precision, recall, f1, support, tp from metrics1")
    q["ev_normal_fpr"] = _sql(
        "conf",
        """select cast(fp as bigint) as fp, cast(tn as bigint) as tn, cast(fp as double)/(fp+tn) as normal_traffic_fpr from (
select sum(n) filter (predicted='Normal Traffic') as fp, sum(n) filter (predicted<>'Normal Traffic') as tn from conf where actual<>'Normal Traffic')""",
    )
    q["ev_report"] = _sql(
        "metrics1",
        """select cast(sum(tp) as double)/sum(support) as accuracy, sum(precision*support)/sum(support) as precision_weighted, sum(recall*support)/sum(support) as recall_weighted,
sum(f1*support)/sum(support) as f1_weighted, cast(sum(support) as bigint) as support from metrics1""",
    )

    # Streams: their finite input is drained, so every row comes out.
    q["st_sessions"] = _sql(
        "sess",
        """select flow_id, start_us, start_packet, end_us, packet_count, byte_count,
 case when finished then 'flow_end' when end_us+30000000<=start_us+120000000 then 'idle_timeout' else 'max_duration' end as reason from sess""",
    )
    q["st_live"] = q["feat_live"]
    q["st_sessions_simple"] = _sql(
        "seqd",
        """select flow_id, min(t_us) as start_us, max(t_us) as end_us, count(*) as packet_count, cast(sum(packet_size) as bigint) as byte_count from (
 select *, sum(case when prev is null or t_us-prev>=30000000 then 1 else 0 end) over (partition by flow_id order by t_us, packet_id) as s from (
  select *, lag(t_us) over (partition by flow_id order by t_us, packet_id) as prev from seqd)) group by flow_id, s""",
    )
    q["st_detect"] = _sql("win brute", "select w.packet_id, w.scan_burst, w.port_sweep, w.syn_only_surge, b.bruteforce from win w left join brute b using (packet_id)")
    q["st_block_state"] = _sql(
        "mldec",
        """select ip, t_us as at_us, seq, status, case when status<>'cooldown_active' then until end as until_us from mldec
union all select ip, until, -1, 'unblocked', null from (select *, lead(t_us) over (partition by ip order by t_us, seq) as nxt from mldec where status<>'cooldown_active')
where nxt is null or nxt>=until""",
    )
    q["st_dedup"] = _sql("evts", "select distinct event_id, ts_us, prediction from evts")
    q["st_telemetry"] = _sql(
        "packets",
        """select e as snapshot_us, count(*) as received, count(*) filter (packet_size=0) as dropped, count(*) filter (packet_size=0)>0 as packet_loss_detected from (
select packet_size, unnest([(((t_us-1)//5000000)+k)*5000000 for k in [1,2,3,4,5,6]]) as e from packets where t_us>0) group by e""",
    )
    q["st_rollup"] = _sql(
        "evts",
        f"""select {h.format("ts_us")} as bucket_start_us, count(*) as ml_prediction_total, count(*) filter (prediction<>'Normal Traffic') as threat_event_total,
count(*) filter (prediction='Normal Traffic') as benign_event_total from evts group by all""",
    )
    return q
