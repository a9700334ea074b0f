"""Labels as columns: attempts, class groups, codes, parts of a path."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATTEMPT = " - Attempted"

# The ten ground-truth classes in code order.
GROUND_TRUTH_CLASSES = (
    "normal", "backdoor", "ddos", "dos", "injection",
    "mitm", "password", "ransomware", "scanning", "xss",
)
GROUND_TRUTH_CODES = {name: code for code, name in enumerate(GROUND_TRUTH_CLASSES)}

# Eight groups and the 34 folder classes in each.
CLASS_GROUPS = {
    "Benign": ("Benign_Final",),
    "DDoS": (
        "DDoS-ACK_Fragmentation", "DDoS-HTTP_Flood", "DDoS-ICMP_Flood", "DDoS-ICMP_Fragmentation",
        "DDoS-PSHACK_Flood", "DDoS-RSTFINFlood", "DDoS-SlowLoris", "DDoS-SYN_Flood",
        "DDoS-SynonymousIP_Flood", "DDoS-TCP_Flood", "DDoS-UDP_Flood", "DDoS-UDP_Fragmentation",
    ),
    "DoS": ("DoS-HTTP_Flood", "DoS-SYN_Flood", "DoS-TCP_Flood", "DoS-UDP_Flood"),
    "Mirai": ("Mirai-greeth_flood", "Mirai-greip_flood", "Mirai-udpplain"),
    "Recon": (
        "Recon-HostDiscovery", "Recon-OSScan", "Recon-PingSweep", "Recon-PortScan", "VulnerabilityScan",
    ),
    "Spoofing": ("DNS_Spoofing", "MITM-ArpSpoofing"),
    "Web": (
        "Backdoor_Malware", "BrowserHijacking", "CommandInjection", "SqlInjection", "Uploading_Attack", "XSS",
    ),
    "BruteForce": ("DictionaryBruteForce",),
}
GROUP_OF = {name: group for group, names in CLASS_GROUPS.items() for name in names}

# Caps per class and data set (flows kept at most; others are kept whole).
GROUND_TRUTH_CAPS = {"normal": 2_000_000, "ddos": 100_000, "dos": 100_000, "scanning": 100_000}
FOLDER_CAPS = {"Benign_Final": 2_000_000} | {
    name: 100_000 for group in ("DDoS", "DoS", "Mirai") for name in CLASS_GROUPS[group]
}
DAY_CAPS = {
    "BENIGN": 200_000, "DoS Hulk": 100_000, "DDoS-HOIC": 100_000, "DDoS-LOIC-HTTP": 100_000,
    "Botnet Ares": 100_000, "SSH-BruteForce": 100_000, "Infiltration - NMAP Portscan": 100_000,
    "DoS GoldenEye": 100_000, "DoS Slowloris": 100_000, "DDoS-LOIC-UDP": 100_000,
    "Web Attack - Brute Force": 100_000, "Web Attack - XSS": 100_000,
}
DAY_CAP_DEFAULT = 100_000
DAY_EXCLUDED = (
    "Infiltration - Communication Victim Attacker", "Infiltration - Dropbox Download",
    "Web Attack - SQL", "FTP-BruteForce",
)

# One day is spelled in two ways.
DAY_ALIASES = {"Thuesday-20-02-2018": "Tuesday-20-02-2018"}

# Dates of the day labels that do not contain one.
WEEKDAY_DATES = {
    "Monday-WorkingHours": "2017-07-03", "Tuesday-WorkingHours": "2017-07-04",
    "Wednesday-workingHours": "2017-07-05", "Thursday-WorkingHours": "2017-07-06",
    "Friday-WorkingHours": "2017-07-07",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(value: Column | str, table: Mapping, default=None) -> Column:
    """Value of a small fixed table, else ``default``."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    found = F.try_element_at(F.create_map(*entries), _col(value))
    return found if default is None else F.coalesce(found, F.lit(default))


def collapse_attempt(label: Column | str, anywhere: bool = False) -> Column:
    """The class without its attempt mark, at the end only or anywhere in the text."""
    if anywhere:
        return F.replace(_col(label), F.lit(ATTEMPT), F.lit(""))
    return F.regexp_replace(_col(label), ATTEMPT + "$", "")


def is_attempt(label: Column | str) -> Column:
    return F.coalesce(_col(label).endswith(ATTEMPT), F.lit(False))


def class_group(label: Column | str) -> Column:
    return lookup(label, GROUP_OF)


def is_benign_folder(label: Column | str) -> Column:
    return _col(label) == "Benign_Final"


def encode_label(label: Column | str, codes: Mapping[str, int], default: int = -1) -> Column:
    return lookup(label, codes, default)


def shown_label(label: Column | str) -> Column:
    return F.coalesce(_col(label), F.lit("<NA>"))


def canonical_day(day: Column | str) -> Column:
    return F.coalesce(lookup(day, DAY_ALIASES), _col(day))


def rule_day(day: Column | str) -> Column:
    """The spelling rule files use for a day."""
    back = {v: k for k, v in DAY_ALIASES.items()}
    return F.coalesce(lookup(canonical_day(day), back), canonical_day(day))


def weekday_date(day: Column | str) -> Column:
    return lookup(day, WEEKDAY_DATES)


def label_index(df: DataFrame, label: str, order: str = "sorted", first: str | None = None, by: str | None = None) -> DataFrame:
    """Data-driven class numbers: (class, class_id).

    ``sorted`` by name, with ``first`` pulled to 0 if given; or ``first_seen`` by the
    smallest value of column ``by``. Only the distinct classes are ever sorted.
    """
    if order == "sorted":
        classes = df.select(F.col(label).alias("class")).distinct()
        keys = [F.when(F.col("class") == first, 0).otherwise(1)] if first else []
        keys.append(F.col("class"))
    elif order == "first_seen":
        classes = df.groupBy(F.col(label).alias("class")).agg(F.min(by).alias("_seen"))
        keys = [F.col("_seen")]
    else:
        raise ValueError(f"unknown order {order!r}")
    number = F.row_number().over(Window.orderBy(*keys)) - 1
    return classes.select("class", number.alias("class_id"))


def class_from_path(path: Column | str) -> Column:
    """Name of the folder a file lies in."""
    return F.element_at(F.split(_col(path), "/"), -2)


def part_from_path(path: Column | str) -> Column:
    """File name without folder and last suffix."""
    return F.regexp_replace(F.element_at(F.split(_col(path), "/"), -1), r"\.[^.]*$", "")
