"""One-to-one pairing of eliminations with deaths, and names with a roster.

The pairing depends on order and learns teams as it goes, so it is a small fold (``folds``) over the sorted rows of a
match; a match has a few hundred. Spark groups the matches and spreads them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.match_rules import ELIMINATIONS
from matchloom.functions.names import clean_reading, fold_name, folded, seq_ratio, similarity
from matchloom.operators.folds import AFTER_MS, LateRows, Pairing, teams_of

LEAST, AHEAD = 0.55, 0.15

#: What the fold over a match says: team (a slot that greyed with a death), pair and settled (a row and its death), no_drop (a row without one), no_row (a death without one).
SETTLED = "match_id long, kind string, event_id long, death_id long, t_ms long, round_no long, team string, slot_id long"
_RECORD = {"kind": "string", "t_ms": "long", "id": "long", "round_no": "long", "team": "string", "victim_id": "long", "named": "boolean", "late": "boolean"}


def _settle(records: pd.DataFrame) -> pd.DataFrame:
    """One match: teams of deaths, rounds of rows (where starts of rounds are given), pairs, and what is left of both."""
    match_id = int(records.match_id.iloc[0])
    kinds = {kind: part.sort_values(["t_ms", "id"]).to_dict("records") for kind, part in records.groupby("kind")}
    at = lambda r: (int(r["t_ms"]), int(r["id"]))
    deaths = {int(d["id"]): d for d in kinds.get("death", [])}
    slots = kinds.get("slot", [])  # sorted; slots that went grey at one time may share an id
    out = []
    for death_id, n in teams_of([at(d) for d in deaths.values()], [(int(s["t_ms"]), n) for n, s in enumerate(slots)]):
        deaths[death_id]["team"] = slots[n]["team"]
        out.append((match_id, "team", None, death_id, deaths[death_id]["t_ms"], None, slots[n]["team"], int(slots[n]["id"])))
    placing, fold = LateRows(), Pairing()
    for s in kinds.get("start", []):
        placing.start(int(s["t_ms"]), int(s["round_no"]))
    for d in deaths.values():
        placing.death(int(d["t_ms"]), int(d["round_no"]))
    line = [(int(d["t_ms"]), 0, k, d) for k, d in deaths.items()] + [(int(r["t_ms"]) + AFTER_MS, 1, int(r["id"]), r) for r in kinds.get("row", [])]
    found = []
    for due, is_row, key, r in sorted(line, key=lambda x: x[:3]):
        found += fold.passed(due)
        if is_row:
            no, late = placing.row(int(r["t_ms"]), True) if "start" in kinds else (int(r["round_no"]), bool(r["late"]))
            found += fold.row(int(r["t_ms"]), key, no, int(r["victim_id"]) if r["victim_id"] >= 0 else None, bool(r["named"]), late)
        else:
            fold.death(due, key, int(r["round_no"]), r["team"])
    for kind, event_id, death_id, t_ms in found + fold.passed(float("inf")):
        death = deaths.get(death_id, {})
        out.append((match_id, kind, event_id, death_id, t_ms, death.get("round_no"), death.get("team"), None))
    frame = pd.DataFrame(out, columns=["match_id", "kind", "event_id", "death_id", "t_ms", "round_no", "team", "slot_id"])
    return frame.astype({c: "Int64" for c in ("event_id", "death_id", "t_ms", "round_no", "slot_id")})


def _records(rows: DataFrame | None, deaths: DataFrame, slots: DataFrame | None = None, rounds: DataFrame | None = None) -> DataFrame:
    def shaped(df: DataFrame, kind: str, **columns: Column | str) -> DataFrame:
        given = {"kind": F.lit(kind)} | columns
        return df.select("match_id", *(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in _RECORD.items()))

    team = F.col("team") if "team" in deaths.columns else F.lit(None)
    line = shaped(deaths, "death", t_ms=F.col("t_ms"), id=F.col("death_id"), round_no=F.coalesce("round_no", F.lit(-1)) if "round_no" in deaths.columns else F.lit(-1), team=team)
    if rows is not None:
        named = F.col("killer_id").isNotNull() | F.col("victim_id").isNotNull()
        given = {"round_no": F.col("round_no"), "late": F.col("late")} if rounds is None else {}
        asked = rows.filter(F.col("event_type").isin(*ELIMINATIONS))
        asked = asked.filter("round_no is not null") if rounds is None else asked
        line = line.unionByName(shaped(asked, "row", t_ms=F.col("feed_ms"), id=F.col("event_id"), victim_id=F.coalesce("victim_id", F.lit(-1)), named=named, **given))
    if slots is not None:
        side = F.col("team") if "team" in slots.columns else F.lit(None)
        line = line.unionByName(shaped(slots, "slot", t_ms=F.col("t_ms"), id=F.col("slot_id"), team=side))
    if rounds is not None:
        line = line.unionByName(shaped(rounds, "start", t_ms=F.col("start_ms"), id=F.col("round_no"), round_no=F.col("round_no")))
    return line


def settle(events: DataFrame, rounds: DataFrame, deaths: DataFrame, slots: DataFrame) -> DataFrame:
    """All that depends on the order of rows and deaths, in one pass over each match (columns of ``SETTLED``).

    events: match_id, event_id, feed_ms, event_type, killer_id, victim_id; rounds: match_id, round_no, start_ms; deaths:
    match_id, death_id, t_ms, round_no; slots: match_id, slot_id, t_ms, team, the slots that went grey. A match is one
    group of a few hundred records.
    """
    return _records(events, deaths, slots, rounds).groupBy("match_id").applyInPandas(_settle, SETTLED)


def pairs(settled: DataFrame) -> DataFrame:
    """match_id, event_id, death_id, t_ms, settled (paired only at the end)."""
    return settled.filter("kind in ('pair', 'settled')").select("match_id", "event_id", "death_id", "t_ms", (F.col("kind") == "settled").alias("settled"))


def no_drop(settled: DataFrame) -> DataFrame:
    """event_id, flag: eliminations that found no death; they are not counted."""
    return settled.filter("kind = 'no_drop'").select("event_id", F.lit("NO_DROP").alias("flag"))


def no_feed_row(settled: DataFrame) -> DataFrame:
    """Deaths that no row claimed, as events without names."""
    return _nameless(settled.filter("kind = 'no_row'"))


def death_teams(settled: DataFrame) -> DataFrame:
    """match_id, death_id, slot_id."""
    return settled.filter("kind = 'team'").select("match_id", "death_id", "slot_id")


def align_elims(rows: DataFrame, deaths: DataFrame) -> DataFrame:
    """rows: match_id, event_id, feed_ms, round_no, event_type, killer_id, victim_id, late; deaths: match_id, death_id, t_ms, round_no, team.

    match_id, event_id, death_id, t_ms, settled (paired only at the end). Rows and deaths without a pair are absent.
    """
    return pairs(_records(rows, deaths).groupBy("match_id").applyInPandas(_settle, SETTLED))


def unpaired_flags(rows: DataFrame, aligned: DataFrame) -> DataFrame:
    """event_id of eliminations that found no death: they are not counted."""
    return rows.filter(F.col("event_type").isin(*ELIMINATIONS) & F.col("round_no").isNotNull()).join(aligned, "event_id", "left_anti").select("event_id", F.lit("NO_DROP").alias("flag"))


def _nameless(deaths: DataFrame) -> DataFrame:
    none = F.lit(None).cast("long")
    return deaths.select("match_id", "death_id", "round_no", F.col("t_ms").alias("true_ms"), F.lit("kill").alias("event_type"), none.alias("killer_id"), none.alias("victim_id"), F.col("team").alias("victim_team"), F.lit("NO_FEED_ROW").alias("flag"))


def unclaimed_deaths(deaths: DataFrame, aligned: DataFrame) -> DataFrame:
    """Deaths that no row claimed, as events without names."""
    return _nameless(deaths.join(aligned.select("match_id", "death_id"), ["match_id", "death_id"], "left_anti"))


#: A letter of a folded name and its how-manieth make one bit of three words; of more than five of a kind the rest are counted.
_KINDS, _TIMES = "0123456789abcdefghijklmnopqrstuvwxyz", 5
_SIGNED = "form string, w0 long, w1 long, w2 long, more int"


def _signature(name: str | None) -> tuple[str, int, int, int, int]:
    """A name's folded form, its letters as bits, and how many letters have none."""
    form = folded(name)
    bits = more = 0
    for c in set(form):
        n = form.count(c)
        bits |= ((1 << min(n, _TIMES)) - 1) << _TIMES * _KINDS.index(c)
        more += max(n - _TIMES, 0)
    return form, bits & (1 << 60) - 1, bits >> 60 & (1 << 60) - 1, bits >> 120, more


def _signed(rows: DataFrame, name: str) -> DataFrame:
    """Distinct names of a roster with their folded form and its letters: what two forms share of these is what they share at most."""

    def sign(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_signature(x) for x in names], columns=[c.split()[0] for c in _SIGNED.split(", ")])

    return rows.select("roster_id", name).distinct().withColumn("x", F.pandas_udf(sign, _SIGNED)(name)).select("roster_id", name, "x.*")


def bounded_pairs(reads: DataFrame, rosters: DataFrame) -> DataFrame:
    """roster_id, raw, name, form, name_form, bound: readings and names of their roster, with the most that their similarity can be, where that is LEAST - AHEAD or more.

    The similarity of two strings is at most twice the letters they share, in any order, by the letters they have. That is worked out by
    built-in functions, on bits. A roster is what one room holds, as rows; rosters grow with the rooms, so they are dealt by room and never broadcast.
    """
    asked = _signed(reads, "raw").filter("form <> ''")
    known = _signed(rosters, "name").select("roster_id", "name", *(F.col(c).alias(f"name_{c}") for c in ("form", "w0", "w1", "w2", "more")))
    shared = F.least("more", "name_more")
    for w in ("w0", "w1", "w2"):
        shared = shared + F.bit_count(F.col(w).bitwiseAND(F.col(f"name_{w}")))
    both = asked.join(known.hint("merge"), "roster_id").withColumn("bound", 2 * shared / (F.length("form") + F.length("name_form")))
    return both.filter(F.col("bound") >= LEAST - AHEAD - 1e-9).select("roster_id", "raw", "name", "form", "name_form", "bound")


def scored_pairs(reads: DataFrame, rosters: DataFrame) -> DataFrame:
    """roster_id, raw, name, score, for all pairs that can decide: those that may be like enough, and then those that may stand in the way of the best of these."""
    likely = F.col("bound") >= LEAST - 1e-9

    def score(asked: Column) -> Column:
        return F.when(asked, seq_ratio(F.when(asked, F.col("form")), F.when(asked, F.col("name_form"))))

    first = bounded_pairs(reads, rosters).withColumn("score", score(likely)).withColumn("best", F.max("score").over(Window.partitionBy("roster_id", "raw")))
    decide = first.filter(F.col("best") >= LEAST).filter(likely | (F.col("bound") > F.col("best") - AHEAD - 1e-9))
    return decide.select("roster_id", "raw", "name", F.coalesce("score", score(~likely)).alias("score"))


def roster_match(reads: DataFrame, rosters: DataFrame) -> DataFrame:
    """reads: roster_id, raw; rosters: roster_id, name. Gives roster_id, raw, name, score.

    The name of the roster most like the reading, if like enough and clearly ahead of the second; else null
    and 0. Distinct readings only. A ratio is worked out only for names that may be it or stand in its way.
    """
    scored = scored_pairs(reads, rosters)
    top = scored.groupBy("roster_id", "raw").agg(F.sort_array(F.collect_list(F.struct("score", "name")), asc=False).alias("top"))
    first, second = F.get("top", F.lit(0)), F.coalesce(F.get("top", F.lit(1))["score"], F.lit(-1.0))
    clear = (first["score"] >= LEAST) & ((second < 0) | (first["score"] - second >= AHEAD))
    found = top.filter(clear).select("roster_id", "raw", first["name"].alias("name"), F.round(first["score"], 2).alias("score"))
    return reads.select("roster_id", "raw").distinct().join(found.hint("merge"), ["roster_id", "raw"], "left").select("roster_id", "raw", "name", F.coalesce("score", F.lit(0.0)).alias("score"))


def roster_collisions(roster: DataFrame) -> DataFrame:
    """Names of a roster that fold to the same string."""
    return roster.select("name").distinct().groupBy(fold_name("name").alias("folded")).agg(F.sort_array(F.collect_list("name")).alias("names")).filter(F.size("names") > 1)


def death_team(deaths: DataFrame, slots: DataFrame) -> DataFrame:
    """deaths: match_id, death_id, t_ms; slots: match_id, slot_id, t_ms. One-to-one: a slot greys from 0.5 s before to 1.5 s after its death."""
    return death_teams(_records(None, deaths.select("match_id", "death_id", "t_ms"), slots.select("match_id", "slot_id", "t_ms")).groupBy("match_id").applyInPandas(_settle, SETTLED))


def row_names(reads: DataFrame, rosters: DataFrame) -> DataFrame:
    """reads: roster_id, read_id, raw (a whole row). Gives read_id, killer, victim.

    Words of four and more characters are looked up in the roster. Of two names found the first is the killer
    and the last the victim; the same name twice is neither. One name alone has a role only at an end of several words.
    """
    words = reads.select("roster_id", "read_id", F.posexplode(F.filter(F.transform(F.split("raw", r"\s+"), lambda x: F.regexp_replace(x, "[^A-Za-z0-9]", "")), lambda x: x != "")).alias("at", "raw"))
    known = roster_match(words.filter(F.length("raw") >= 4), rosters).filter("name is not null")
    found = words.join(known.hint("merge"), ["roster_id", "raw"], "left").groupBy("read_id").agg(
        F.min(F.when(F.col("name").isNotNull(), F.struct("at", "name"))).alias("a"), F.max(F.when(F.col("name").isNotNull(), F.struct("at", "name"))).alias("z"), F.max("at").alias("end")
    )
    two, same = F.col("a.at") != F.col("z.at"), F.col("a.name") == F.col("z.name")
    killer = F.when(two & ~same, F.col("a.name")).when(~two & (F.col("a.at") == 0) & (F.col("end") > 0), F.col("a.name"))
    victim = F.when(two & ~same, F.col("z.name")).when(~two & (F.col("a.at") == F.col("end")) & (F.col("end") > 0), F.col("a.name"))
    return reads.select("read_id").join(found.select("read_id", killer.alias("killer"), victim.alias("victim")).hint("merge"), "read_id", "left")


def name_consensus(reads: DataFrame) -> DataFrame:
    """reads: key, raw. The spelling that two readings and 40 % of them agree on, else the one most like all others; and the share that agrees.

    Of two spellings on which as many agree, the one more like all others. Equal spellings are counted before anything is gathered, so a list is as long as a key has different ones.
    """

    def settle(lists: pd.Series) -> pd.DataFrame:
        out = []
        for spellings in lists:
            count = {x["raw"]: x["n"] for x in sorted(spellings, key=lambda x: x["raw"])}
            total = sum(count.values())
            most = max(count.values(), default=0)
            agreed = most >= 2 and most / total >= 0.4
            asked = [x for x, n in count.items() if n == most or not agreed]
            top = asked[0] if asked else ""
            if len(asked) > 1:
                forms = [(folded(x), n) for x, n in count.items()]
                top = max(asked, key=lambda x: round(sum(n * similarity(folded(x), f) for f, n in forms), 9))  # of equals the first
            out.append((top, round(count.get(top, 0) / total, 2) if total else 0.0))
        return pd.DataFrame(out, columns=["name", "share"])

    counts = reads.groupBy("key", clean_reading(F.trim("raw")).alias("raw")).agg(F.count("*").alias("n"))
    lists = counts.groupBy("key").agg(F.collect_list(F.when(F.col("raw") != "", F.struct("raw", "n"))).alias("raws"))
    return lists.select("key", F.pandas_udf(settle, "name string, share double")("raws").alias("x")).select("key", "x.*")
