"""Metrics, limits and checks of parameters."""

from __future__ import annotations

METRICS = ("l2", "cosine", "ip")
MAX_DIMENSION = 65_536
MAX_RESULTS = 2_048
#: kind numbers of typed metadata values
STRING, INTEGER, FLOAT, BOOLEAN = 0, 1, 2, 3
METADATA_VALUE = "struct<kind:tinyint,s:string,i:bigint,f:double,b:boolean>"
METADATA = f"map<string,{METADATA_VALUE}>"


def between(name: str, value: int, low: int, high: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{name} must be a whole number from {low} to {high}")
    return value


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    return metric


def check_dimension(d: int) -> int:
    return between("dimension", d, 1, MAX_DIMENSION)


def check_results(n: int) -> int:
    return between("n_results", n, 1, MAX_RESULTS)


def check_links(m: int) -> int:
    return between("M", m, 2, 1000)


def check_ef(name: str, ef: int) -> int:
    return between(name, ef, 1, 2048)


def check_ratio(ratio: float) -> float:
    if not 0 <= ratio <= 1:
        raise ValueError("deleted_ratio must lie between 0 and 1")
    return ratio
