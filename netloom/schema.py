"""Fixed schemas and fixed values shared by every operator."""

from pyspark.sql import types as T

# IP protocol numbers.
TCP, UDP, ICMP, UNKNOWN = 6, 17, 1, 0

PACKET_SCHEMA = T.StructType(
    [
        T.StructField("packet_id", T.LongType(), False),
        T.StructField("t_us", T.LongType(), False),
        T.StructField("wall_us", T.LongType(), True),
        T.StructField("src_ip", T.StringType(), False),
        T.StructField("dst_ip", T.StringType(), False),
        T.StructField("protocol", T.IntegerType(), False),
        T.StructField("packet_size", T.LongType(), False),
        T.StructField("src_port", T.LongType(), True),
        T.StructField("dst_port", T.LongType(), True),
        T.StructField("tcp_flags", T.IntegerType(), True),
        T.StructField("tcp_window_size", T.LongType(), True),
        T.StructField("tcp_header_length", T.LongType(), True),
        T.StructField("transport_header_length", T.LongType(), True),
        T.StructField("payload_size", T.LongType(), True),
    ]
)

# Source-side table of the driver, given explicitly so that streams need no inference.
EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

# Raw column name of the public CIC-IDS-2018 flow files -> feature name,
# in the canonical order of the 37 features.
RAW_TO_FEATURE = {
    "Dst Port": "dst_port",
    "Protocol": "protocol",
    "Flow Duration": "flow_duration",
    "Tot Fwd Pkts": "total_fwd_packets",
    "TotLen Fwd Pkts": "total_fwd_bytes",
    "Flow Byts/s": "flow_bytes_per_sec",
    "Flow Pkts/s": "flow_packets_per_sec",
    "Pkt Len Min": "packet_len_min",
    "Pkt Len Max": "packet_len_max",
    "Pkt Len Mean": "packet_len_mean",
    "Pkt Len Std": "packet_len_std",
    "Pkt Len Var": "packet_len_variance",
    "Pkt Size Avg": "avg_packet_size",
    "Fwd Pkt Len Min": "fwd_packet_len_min",
    "Fwd Pkt Len Max": "fwd_packet_len_max",
    "Fwd Pkt Len Mean": "fwd_packet_len_mean",
    "Fwd Pkt Len Std": "fwd_packet_len_std",
    "Flow IAT Min": "flow_iat_min",
    "Flow IAT Max": "flow_iat_max",
    "Flow IAT Mean": "flow_iat_mean",
    "Flow IAT Std": "flow_iat_std",
    "Fwd IAT Min": "fwd_iat_min",
    "Fwd IAT Max": "fwd_iat_max",
    "Fwd IAT Mean": "fwd_iat_mean",
    "Fwd IAT Std": "fwd_iat_std",
    "Fwd IAT Tot": "fwd_iat_total",
    "Fwd Pkts/s": "fwd_packets_per_sec",
    "FIN Flag Cnt": "fin_flag_count",
    "SYN Flag Cnt": "syn_flag_count",
    "RST Flag Cnt": "rst_flag_count",
    "PSH Flag Cnt": "psh_flag_count",
    "ACK Flag Cnt": "ack_flag_count",
    "URG Flag Cnt": "urg_flag_count",
    "Fwd Header Len": "fwd_header_length",
    "Init Fwd Win Byts": "init_win_bytes_forward",
    "Fwd Act Data Pkts": "act_data_pkt_fwd",
    "Fwd Seg Size Min": "min_seg_size_forward",
}
FEATURES = list(RAW_TO_FEATURE.values())
LABEL = "Attack Type"
RAW_LABEL = "Label"

# Raw columns recorded in microseconds.
RAW_MICROS = [
    "Flow Duration",
    "Flow IAT Min",
    "Flow IAT Max",
    "Flow IAT Mean",
    "Flow IAT Std",
    "Fwd IAT Min",
    "Fwd IAT Max",
    "Fwd IAT Mean",
    "Fwd IAT Std",
    "Fwd IAT Tot",
]

# Features that hold whole numbers.
WHOLE_FEATURES = [
    "dst_port",
    "protocol",
    "total_fwd_packets",
    "total_fwd_bytes",
    "fin_flag_count",
    "syn_flag_count",
    "rst_flag_count",
    "psh_flag_count",
    "ack_flag_count",
    "urg_flag_count",
    "fwd_header_length",
    "init_win_bytes_forward",
    "act_data_pkt_fwd",
    "min_seg_size_forward",
]

# The ten daily files of a prepared data set, in order.
PREPARED_FILES = [
    "prepared_02-14-2018.csv",
    "prepared_02-15-2018.csv",
    "prepared_02-16-2018.csv",
    "prepared_02-20-2018.csv",
    "prepared_02-21-2018.csv",
    "prepared_02-22-2018.csv",
    "prepared_02-23-2018.csv",
    "prepared_02-28-2018.csv",
    "prepared_03-01-2018.csv",
    "prepared_03-02-2018.csv",
]

# Text that marks a missing label, compared in lower case.
BAD_LABELS = ["", "nan", "none", "null", "label", "attack type"]

# TCP flag bits.
TCP_FLAG_BITS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32}

# Ports whose probing is suspicious, and ports watched for password guessing.
SENSITIVE_PORTS = [21, 22, 23, 25, 53, 80, 110, 135, 139, 143, 443, 445, 3389]
LOGIN_PORTS = [21, 22, 23, 25, 110, 143, 3389]

NORMAL = "Normal Traffic"
SECOND = 1_000_000
