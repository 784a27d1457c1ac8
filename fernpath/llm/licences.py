"""Licence detection by ordered signature rules that are tried only where their keyword occurs.

The rules stand in `licence_rules`. Of overlapping detections those that lie within a stronger one are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fernpath.llm.common import blocks, out, raw, table
from fernpath.llm.licence_rules import NAMES, TAGS, TEXTS, VERSIONS

_W = rb"[0-9a-z\x80-\xff]"
_N = rb"[^0-9a-z\x80-\xff]"

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Priority and weight of the rules of each list.
LISTS = [(4, 1.0, TEXTS), (3, 1.0, TAGS), (2, 0.9, VERSIONS), (1, 0.6, NAMES)]
#: What says little about a licence.
WEAK = {"copyright": 0.3, "all-rights-reserved": 0.3, "no-warranty": 0.5, "warranty-disclaimer": 0.5}
_BETWEEN = r"(?:\s*[,(-]?\s*(?:version|ver\.|v\.|v)?\s*)"
_END = r"(?!\.?[0-9])"


@dataclass(frozen=True)
class Rule:
    priority: int
    needs: tuple[bytes, ...]  # every match of the pattern contains one of them
    pattern: re.Pattern
    label: str
    weight: float


def _pattern(body: str) -> re.Pattern:
    first, last = body[0].isalnum() or body.startswith("(?:"), body[-1].isalnum() or body.endswith((")?", ")"))
    made = re.sub(" (?!\\?)", r"\\s+", body.replace("[- ]", "(?:-| )")).replace(" ?", r"\s*")
    made = made.replace("{v}", _BETWEEN).replace("{e}", _END)
    edge = _W.decode("latin-1")
    return re.compile((f"(?<!{edge})" * first).encode("latin-1") + b"(?:" + made.encode() + b")" + (f"(?!{edge})" * last).encode("latin-1"), re.DOTALL)


def rules() -> list[Rule]:
    """All rules, those of highest priority first."""
    return [
        Rule(priority, tuple(k.encode() for k in keywords.split("|")), _pattern(body), label, WEAK.get(label, weight))
        for priority, weight, some in LISTS
        for label, keywords, body, _ in some
    ]


def detections(low: bytes, ordered: list[Rule]) -> list[tuple[int, int, str, float]]:
    """(start, end, label, weight) in bytes, by start. A detection within one of higher priority, or within a longer or earlier one as high, is dropped."""
    found, here, flat = [], {}, b" ".join(low.split())  # a keyword may be broken over lines
    for k, rule in enumerate(ordered):
        for need in rule.needs:
            if need not in here:
                here[need] = need in flat
            if here[need]:
                found += [(m.start(), -m.end(), -rule.priority, k, m) for m in rule.pattern.finditer(low)]
                break
    found.sort(key=lambda x: x[:4])
    kept, reach = [], [0] * (1 + max((r.priority for r in ordered), default=0))  # by priority: the furthest end of what began before
    for start, end, priority, k, m in found:
        if max(reach[-priority:]) < -end:
            label = ordered[k].label
            kept.append((start, -end, label.format(m[1].decode("utf-8", "replace")) if "{}" in label else label, ordered[k].weight))
        reach[-priority] = max(reach[-priority], -end)
    return kept


_IS_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_BASE = [(label, re.compile(b"(?<!" + _W + b")" + (_N + b"+").join(w.encode() for w in phrase.split()) + b"(?!" + _W + b")")) for phrase, label in BASE.items()]


def word_starts(data: bytes) -> np.ndarray:
    inside = _IS_WORD[np.frombuffer(data, np.uint8)]
    return inside & ~np.concatenate(([False], inside[:-1]))


def scan(docs: DataFrame) -> DataFrame:
    """A row for each row of documents; a null text has no words and no labels. Rows are scanned one by one, so repeated ones agree.

    score is the largest weight of the rules that found something, 0.5 at least where a base phrase stands, else 0.
    """
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = rules()
        # a text without any of these words lacks the keywords of every rule
        gates = _gates([max(w.split(), key=len) for r in ordered for w in r.needs])
        for part in blocks(batches):
            rows = []
            for data in part.column("text").to_pylist():
                low, starts = data.lower(), word_starts(data)
                places = [(m.start(), label) for label, p in _BASE for m in p.finditer(low)] if b"license" in low else []
                found = detections(low, ordered) if any(g in low for g in gates) else []
                before = np.cumsum(starts) if places else starts
                at = [int(before[p]) - 1 for p, _ in places]
                base = sorted({label for _, label in places})
                labels = sorted({*base, *(label for _, _, label, _ in found)})
                score = max([0.5 if base else 0.0, *(w for *_, w in found)])
                rows.append((int(np.count_nonzero(starts)), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(labels), score))
            yield out(schema, part.column("doc_id"), *zip(*rows, strict=True))

    return raw(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def _gates(keywords: list[bytes]) -> list[bytes]:
    """The shortest keywords that every keyword contains one of."""
    found: list[bytes] = []
    for k in sorted(set(keywords), key=len):
        if not any(g in k for g in found):
            found.append(k)
    return found


def op5_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in every document; see `scan` for odd rows."""
    return scan(table(spark, sf_dir, "documents"))
