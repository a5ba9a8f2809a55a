"""The small behaviour scorer: a synthetic training corpus, logistic regression by gradient descent, explainable scores."""

from __future__ import annotations

import math
import random
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import sigmoid, verdict
from .events import behaviour_features, techniques_of_runs
from .tokens import nearest_prototype

FEATURES = ("n_inject", "n_persist", "n_impact", "n_exec_script", "n_c2", "n_drop", "n_file_write", "n_delete", "frac_suspicious")

# --- fixed values of the synthetic corpus: families and what each tag records

FAMILIES = {"sim-ransom": ["vss", "encrypt", "runkey", "net"], "sim-injector": ["inject", "net", "dns", "drop"], "sim-persist-loader": ["enc_ps", "schtask", "drop", "net", "runkey"]}
TAG_EVENTS = {
    "vss": ("process_create", "vssadmin.exe", "vssadmin delete shadows /all /quiet"),
    "runkey": ("registry_set", r"HKCU\Software\Microsoft\Windows\CurrentVersion\Run\updater", None),
    "net": ("net_connect", "203.0.113.66:8443", None),
    "dns": ("dns_query", "c2.lab.invalid", None),
    "inject": ("process_inject", "explorer.exe", None),
    "drop": ("file_write", r"C:\Users\lab\AppData\Roaming\svc.exe", None),
    "enc_ps": ("process_create", "powershell.exe", "powershell -enc SQBFAFgA"),
    "schtask": ("scheduled_task", r"\Updater", None),
}
BENIGN_KINDS = ["file_read", "file_write", "dns_query", "net_connect", "file_read"]
BENIGN_TARGETS = {"file_read": r"C:\Users\lab\Documents\doc{i}.txt", "file_write": r"C:\Users\lab\AppData\Local\app\cache{i}.dat", "dns_query": "updates.example.com", "net_connect": "198.51.100.10:443"}


@lru_cache(maxsize=4)
def synthetic_runs(n: int = 120, seed: int = 7) -> tuple[tuple[tuple, ...], tuple[tuple, ...]]:
    """(events, runs) of the training corpus; even runs are benign. Draws follow one seeded generator, so rows never change."""
    draw = random.Random(seed)
    events, runs = [], []

    def benign(run: str) -> list[tuple]:
        made = []
        for i in range(draw.randint(3, 10)):
            kind = draw.choice(BENIGN_KINDS)
            made.append((run, float(i), kind, 100, "app.exe", BENIGN_TARGETS[kind].format(i=i), None))
        return made

    names = list(FAMILIES)
    for i in range(n):
        if i % 2 == 0:
            run, family, rows = f"benign-{i}", None, benign(f"benign-{i}")
        else:
            family = names[i % len(names)]
            run = f"{family}-{i}"
            tags = [t for t in FAMILIES[family] if draw.random() > 0.15] or FAMILIES[family][:1]
            rows, at = benign(run)[:2], 5.0
            for tag in tags:
                at += draw.uniform(0.1, 2.0)
                if tag == "encrypt":
                    rows += [(run, at + k * 0.01, "file_write", 200, "sample.exe", rf"C:\Users\lab\Documents\f{k}.docx.locked", None) for k in range(draw.randint(3, 6))]
                else:
                    kind, target, cmdline = TAG_EVENTS[tag]
                    rows.append((run, at, kind, 200, "sample.exe", target, cmdline))
        runs.append((run, int(i % 2), family))
        events += [(*r[:2], seq, *r[2:]) for seq, r in enumerate(rows)]
    return tuple(events), tuple(runs)


def synthetic_events(spark: SparkSession, n: int = 120, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    events, runs = synthetic_runs(n, seed)
    return spark.createDataFrame(list(events), "run_id string, ts double, seq int, type string, pid int, image string, target string, cmdline string"), spark.createDataFrame(list(runs), "run_id string, label int, family string")


def descend(x: list[list[float]], y: list[int], rate: float = 0.3, rounds: int = 400, ridge: float = 0.01) -> tuple[list[float], float]:
    """Logistic regression by full-batch gradient descent from zero; the penalty spares the intercept. For small tables."""
    import numpy as np

    a, t = np.array(x), np.array(y, float)
    w, b = np.zeros(a.shape[1]), 0.0
    for _ in range(rounds):
        off = 1 / (1 + np.exp(-np.clip(a @ w + b, -30, 30))) - t
        b, w = b - rate * off.mean(), w - rate * (a.T @ off / len(t) + ridge * w)
    return [float(v) for v in w], float(b)


_MODELS: dict[tuple[int, int], tuple[list[float], float]] = {}


def trained(spark: SparkSession, n: int = 120, seed: int = 7) -> tuple[list[float], float]:
    """(weights in the order of FEATURES, intercept) from the synthetic corpus; its rows are few by construction."""
    if (n, seed) not in _MODELS:
        events, runs = synthetic_events(spark, n, seed)
        rows = behaviour_features(events, runs).join(runs.select("run_id", "label"), "run_id").orderBy("run_id").collect()
        _MODELS[n, seed] = descend([[r[f] for f in FEATURES] for r in rows], [r["label"] for r in rows])
    return _MODELS[n, seed]


def behaviour_scores(events: DataFrame, weights: list[float], intercept: float, runs: DataFrame | None = None) -> DataFrame:
    """(run_id, probability, label, contributions): contributions sorted by what they add, greatest first."""
    rows = behaviour_features(events, runs)
    z = F.lit(intercept)
    for f, w in zip(FEATURES, weights):
        z = z + F.col(f) * F.lit(w)
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), F.round(f, 4).alias("value"), F.lit(round(w, 4)).alias("weight"), F.round(F.round(f, 4) * F.lit(round(w, 4)), 4).alias("impact")) for f, w in zip(FEATURES, weights)])
    used = F.filter(parts, lambda c: c["value"] != 0)
    by_impact = F.array_sort(used, lambda a, b: F.when(F.abs(a["impact"]) > F.abs(b["impact"]), -1).when(F.abs(a["impact"]) < F.abs(b["impact"]), 1).otherwise(0))
    p = sigmoid(z)
    return rows.select("run_id", F.round(p, 4).alias("probability"), verdict(p).alias("label"), by_impact.alias("contributions"))


def family_of_runs(events: DataFrame, prototypes: DataFrame, least: float = 0.5) -> DataFrame:
    """(run_id, family, similarity) by Jaccard of technique sets against (proto_id, family, techniques)."""
    sets = techniques_of_runs(events).withColumnRenamed("techniques", "tokens")
    near = nearest_prototype(sets, prototypes.withColumnRenamed("techniques", "tokens"))
    return near.select("run_id", F.when(F.col("similarity") >= least, F.col("family")).alias("family"), F.round("similarity", 3).alias("similarity"))


def normal_quantile_z(confidence: float = 0.95) -> float:
    """z of a two-sided interval, by bisection of the error function."""
    low, high = 0.0, 10.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erf(mid / math.sqrt(2)) < confidence else (low, mid)
    return low
