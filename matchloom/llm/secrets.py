r"""Secret scans with multipart credential linking.

One pass over the texts finds the base spans (assignments, access keys, long hex runs) and the parts of
credentials: identifiers, secrets and endpoints. Base spans are always reported. A weak part (a short
assigned value, a mixed token, a client or user name, a host) is no finding by itself: it is reported only
when parts of both other roles begin within ``SCOPE`` characters of it in the same document.

That interval join never forms pairs: the parts of a document are ordered by position, and a range
window over ``SCOPE`` characters before and after a part says which roles occur there. Only documents with
weak parts and all three roles take part in the shuffle.

Spans count code points, end exclusive. Edge cases: a null text is empty; repeated rows are judged alike;
a weak part that overlaps a base span is not reported again; spans may be of any length (of a URL's scheme the last
21 characters count); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import identified, real_id, stored

SCOPE = 300
#: Order of kinds in a list of spans.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ROLES = ("identifier", "secret", "endpoint")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAME = re.compile(r"""\b(?:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.IGNORECASE | re.ASCII)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_HOST = re.compile(r"""[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]{3,}|\b(?:host(?:name)?|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:-]{3,}|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])""", re.ASCII)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isupper() for c in token) and any(c.islower() for c in token)


def _joined(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Sorted spans with those that overlap put together."""
    out: list[list[int]] = []
    for s, e in spans:
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _meets(taken: list[list[int]], s: int, e: int) -> bool:
    """Whether a span overlaps one of some spans apart: of those that begin before its end only the last can."""
    k = bisect_left(taken, [e])
    return k > 0 and taken[k - 1][1] > s


def parts(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, bool]]:
    """(role, start, end, weak): base spans take part with their role, weak ones wait for the others."""
    roles = {"assign": "secret", "access": "identifier", "hex": "secret"}
    strong = [(roles[k], s, e, False) for k, s, e in base]
    hosts = [("endpoint", m.start(), m.end(), True) for m in _HOST.finditer(text)] if ":" in text or "=" in text or "." in text else []
    if not hosts:
        return []
    equals = ":" in text or "=" in text
    names = [("identifier", m.start(), m.end(), True) for m in _NAME.finditer(text)] if equals else []
    if not names and not any(p[0] == "identifier" for p in strong):
        return []
    values = [("secret", m.start(), m.end(), True) for m in _ASSIGN.finditer(text) if 4 <= len(m[2]) < 12] if equals else []
    values += [("secret", m.start(), m.end(), True) for m in _TOKEN.finditer(text) if _mixed(m[0])]
    if not values and not any(p[0] == "secret" for p in strong):
        return []
    taken = _joined(sorted((s, e) for _, s, e, _ in strong))
    free = [p for p in hosts + names + values if not _meets(taken, p[1], p[2])]
    return sorted({*strong, *free}, key=lambda p: (p[1], p[2], p[0])) if free else []


def _text_of(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SPAN = "kind string, s int, e int"
FOUND = f"doc_id long, text_hash long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>, parts array<struct<role:string,s:int,e:int,weak:boolean>>"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for doc_id, text_hash, text in zip(rows.doc_id, rows.text_hash, rows.text, strict=True):
            base = base_spans(text)
            kinds = [k for k, _, _ in base]
            out.append(
                (
                    doc_id, text_hash, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(_text_of(base).encode()).hexdigest(),
                    [{"kind": k, "s": s, "e": e} for k, s, e in base], [{"role": r, "s": s, "e": e, "weak": w} for r, s, e, w in parts(text, base)],
                )
            )
        yield pd.DataFrame(out, columns=["doc_id", "text_hash", "n_assign", "n_access", "n_hex", "base_sha256", "base", "parts"])


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per document with any: its weak parts that have both other roles within ``scope`` characters."""
    spread = found.filter(F.size("parts") > 0).select("doc_id", "text_hash", F.explode("parts").alias("p")).select("doc_id", "text_hash", "p.*").distinct()
    # a part stands at its start; the scope is measured from start to start
    reach = Window.partitionBy("doc_id", "text_hash").orderBy("s").rangeBetween(-scope, scope)
    roles = {f"has_{r}": F.max(F.col("role") == r).over(reach) for r in ROLES}
    near = spread.withColumns(roles)
    both = F.lit(True)
    for r in ROLES:
        both = both & F.col(f"has_{r}")
    return near.filter(F.col("weak") & both).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(F.col("role").alias("kind"), "s", "e")).alias("linked"))


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, text_hash, n_assign, n_access, n_hex, base_sha256, spans array<struct<kind, s, e>>."""
    found = stored(identified(docs).mapInPandas(_scan, FOUND))
    all_spans = F.concat("base", F.coalesce("linked", F.array().cast(f"array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>")))
    rank = F.create_map(*(F.lit(x) for pair in zip(KINDS, range(len(KINDS)), strict=True) for x in pair))
    # stored, so that a document which is repeated very often can be split among tasks
    links = stored(linked(found, scope))
    ordered = F.transform(F.sort_array(F.transform(all_spans, lambda x: F.struct(x["s"], rank[x["kind"]].alias("k"), x["e"], x["kind"]))), lambda x: F.struct(x["kind"], x["s"], x["e"]))
    return found.drop("parts").join(links, ["doc_id", "text_hash"], "left").withColumn("spans", ordered).drop("base", "linked")


def secrets_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    return secret_spans(docs).select(real_id(), "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"))
