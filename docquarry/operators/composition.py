"""Lists of what a submission consists of: the children of a numbered introduction, the titles that follow an anchor, and sections that are no such lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import compact
from docquarry.operators.folds import folded

#: Characters up to which wrapping titles and other titles before a list are passed over, items after which a closing wrapper ends one,
#: and items that make a list: with a marked one among them, and without.
WRAPPER, BEFORE, CLOSING, MARKED, UNMARKED = 32, 28, 10, 3, 5
#: Header words of forms for checking and reviewing.
HEADERS = ("自查结论", "证明资料位置", "评审内容", "是否符合")


def _say(text: Column, words: tuple[str, ...]) -> Column:
    """Whether text, compacted, holds one of the words."""
    return F.coalesce(F.array_contains(F.transform(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), True), F.lit(False))


@dataclass(frozen=True)
class Clauses:
    """Words of risk clauses and review tables, without white space. Fixed values."""

    deposit: str = "保证金"
    proofs: tuple[str, ...] = ("保证金登记表", "保证金进账凭证", "保证金缴纳凭证", "保证金凭证", "保证金证明", "保证金保函", "银行保函", "汇款凭证", "转账凭证", "银行回单", "收据")
    invalid: tuple[str, ...] = ("无效报价", "无效响应", "否决", "废标", "有效性认定", "资格的取消")
    forfeit: tuple[str, ...] = ("不予退还", "没收", "否决其投标", "撤销投标文件", "视为放弃")
    kept: tuple[str, ...] = ("放弃中标", "退还保证金", "转为合同履约保证金", "保证金将")
    table: str = "表"


def risk_clause(title: Column, relevance: Column, content: Column, words: Clauses = Clauses(), head: int = 1800) -> Column:
    """Whether a section speaks of invalid or forfeited submissions, by its title, relevance and the first `head` characters: not if its title names a proof of a
    deposit; if title or relevance speak of invalidity; else, of sections on deposits, those with a clause on keeping them, or, where a proof is named, on forfeit."""
    t, r, c = (compact(F.coalesce(x, F.lit(""))) for x in (title, relevance, F.left(content, F.lit(head))))
    proof = lambda x: F.contains(x, F.lit(words.deposit)) & _say(x, words.proofs)
    whole = F.concat(t, r, c)
    clause = F.when(proof(whole), _say(whole, words.forfeit)).otherwise(_say(whole, words.forfeit + words.kept))
    return F.when(proof(t), False).when(_say(t, words.invalid) | _say(r, words.invalid), True).otherwise(F.contains(F.concat(t, r), F.lit(words.deposit)) & clause)


def review_table(title: Column, content: Column, intro: str, headers: tuple[str, ...] = HEADERS, words: Clauses = Clauses(), lines: int = 80, near: int = 300) -> Column:
    """Whether a section is a form for checking or reviewing: two header words or more in its first `lines` lines, a bar there or a table in title or beginning,
    and no line that introduces a list (the pattern intro) before the first line with two header words."""
    hits = lambda x: F.aggregate(F.array(*map(F.lit, headers)), F.lit(0), lambda n, h: n + F.contains(x, h).cast("int"))
    head = F.slice(F.split(F.coalesce(content, F.lit("")), r"\r\n|\n|\r"), 1, lines)
    sample = F.array_join(head, "\n")
    first = lambda test: F.array_position(F.transform(head, test), True)
    header, opening = first(lambda x: hits(compact(x)) >= 2), first(lambda x: x.rlike(intro))
    shaped = F.contains(sample, F.lit("|")) | F.contains(F.coalesce(title, F.lit("")), F.lit(words.table)) | F.contains(F.left(sample, F.lit(near)), F.lit(words.table))
    return (hits(compact(sample)) >= 2) & ~((opening > 0) & (header > 0) & (opening < header)) & shaped


def _child(state: dict, r: dict) -> list:
    waiting, running = state.setdefault("waiting", {}), state.setdefault("running", {})
    number, out = r["q_number"], []
    for parent in [p for p in running if not number.startswith(p + ".")]:
        del running[parent]
    above = number.rpartition(".")[0]
    if above in waiting:
        running.setdefault(above, []).extend(waiting.pop(above))
    if above in running:
        out = [{"intro": i, "pos": r["pos"]} for i in running[above]]
    if r["q_intro"]:
        waiting.setdefault(r["q_intro"], []).append(r["pos"])
    return out


def numbered_children(lines: DataFrame, doc: str, pos: str, line: str, intro: Column, least: int = 3) -> DataFrame:
    """doc, intro, pos of the lines directly below a document's first numbered introduction that has `least` of them or more.

    A child's number is its introduction's and one part more; deeper lines between children are passed over, and the first line after a child that has no number,
    or one elsewhere, ends the list. Lines before the first child don't matter. A document's introductions are all followed in one pass.
    """
    text = F.regexp_replace(F.coalesce(F.col(line), F.lit("")), r"^[\s\p{Z}]+", "")
    number = lambda most: F.regexp_extract(text, rf"^([0-9]+(?:\.[0-9]+){{1,{most}}})", 1)
    told = lines.select(doc, F.col(pos).cast("long").alias("pos"), number(4).alias("q_number"), F.when(intro, number(3)).alias("q_intro"))
    found = folded(told, doc, ["pos"], dict, _child, "intro long, pos long")
    first = found.groupBy(doc, "intro").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).groupBy(doc).agg(F.min("intro").alias("q_first"))
    same = found[doc].eqNullSafe(first[doc]) & (found["intro"] == first["q_first"])
    return found.join(first, same, "left_semi")


#: What collected titles can be (columns of truths): the head of a list of its own, a stop, a detail or a part of what stands above, a wrapping title, one that
#: closes a long list, one that is left out inside lists, an item, an item that marks a list.
TITLES = ("unified", "stop", "detail", "header", "wrapper", "closing", "left_out", "item", "marked")


def _collect(state: dict, r: dict) -> list:
    out = []
    if r["q_size"]:
        lists = []
        for anchors, n in state.setdefault("lists", []):
            if r["unified"] or r["stop"]:
                continue
            passed = r["detail"] or r["header"] or (r["wrapper"] and not (r["closing"] and n >= CLOSING)) or (r["left_out"] and not r["wrapper"])
            if not passed and (r["wrapper"] or not r["item"]):
                continue
            if not passed:
                out += [{"anchor": a, "pos": r["pos"], "marked": bool(r["marked"])} for a in anchors]
            lists.append((anchors, n + (not passed)))
        waiting = state.pop("waiting", [])
        if waiting and not r["header"] and not r["wrapper"] and r["item"]:
            out += [{"anchor": a, "pos": r["pos"], "marked": bool(r["marked"])} for a in waiting]
            lists.append((waiting, 1))
            waiting = []
        elif not (r["header"] or r["q_size"] <= (WRAPPER if r["wrapper"] else BEFORE)):
            waiting = []
        state["lists"], state["waiting"] = lists, waiting
    if r["q_anchor"]:
        state.setdefault("waiting", []).append(r["pos"])
    return out


def following_titles(sections: DataFrame, doc: str, pos: str, title: str, anchor: str) -> DataFrame:
    """doc, anchor, pos of the sections whose titles list what an anchor section announces; sections have the truths TITLES, null for false.

    From the section behind the anchor on, short titles that are no items, part headers and short wrapping titles are passed over until the first item. Then items are
    taken; details, part headers, wrapping titles and what is left out are passed over; anything else ends the list, as do the head of another one, a stop, and
    a closing wrapper after ten items. Lists of five stay, and of three if one of these is marked. Sections without a title are passed over. Anchors that
    wait for the same first item are followed together, so a document is read once.
    """
    size = F.length(compact(F.coalesce(F.col(title), F.lit(""))))
    told = sections.select(doc, F.col(pos).cast("long").alias("pos"), size.alias("q_size"), F.col(anchor).alias("q_anchor"), *TITLES)
    found = folded(told, doc, ["pos"], dict, _collect, "anchor long, pos long, marked boolean")
    counted = found.groupBy(F.col(doc).alias("q_doc"), F.col("anchor").alias("q_anchor")).agg(F.count(F.lit(1)).alias("n"), F.max("marked").alias("m")).where(f"n >= {UNMARKED} OR n >= {MARKED} AND m")
    return found.join(counted, F.col(doc).eqNullSafe(F.col("q_doc")) & (F.col("anchor") == F.col("q_anchor")), "left_semi").select(doc, "anchor", "pos")
