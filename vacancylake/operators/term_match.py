"""Matching texts against term dictionaries.

Two plans give the same matches:

* ``TermIndex`` holds a bounded dictionary as literals and matches inside the row.  Nothing
  is shuffled, so a long or often repeated text costs no more than its own scan.
* ``match_by_join`` takes a dictionary of any size as a DataFrame: texts are exploded to
  their distinct words and joined on the first word of each surface form, or to phrases and
  joined on whole forms.

``plans.enrich`` chooses between them by the number of forms; the matches are the same.

A surface form counts when it occurs as whole words after both sides went through
``functions.text.match_form``.  The term itself beats its aliases, an earlier alias a later.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacancylake.functions.arrays import constant, let, tagged
from vacancylake.functions.spotting import LABELS, token_forms
from vacancylake.functions.text import match_form, per_batch, word_places, words_finder
from vacancylake.operators.phrases import PhraseGate, phrases
from vacancylake.schemas import MATCH
from vacancylake.session import materialize
from vacancylake.sources.vocabulary import DICTIONARIES, Term, flatten

EXACT_SCORE = 1.0
ALIAS_SCORE = 0.9
SCORED = ["skills", "technologies", "soft_skills", "industry_terms"]
# Seniority is read off the groups of one dictionary whose names hold one of these.
SENIORITY_DICT = "vietnamese_keywords"
SENIORITY_MARKS = ["level", "seniority"]

MAX_INDEX_FORMS = 5_000
#: A place in a text takes fewer bits than these.
PLACE_BITS = 32

_MATCH_FIELDS = ["keyword", "matched_text", "score", "match_type", "category", "weight", "subcategory"]

def plain_form(surface: str) -> str:
    """``functions.text.match_form`` for a surface form known on the driver."""
    kept = "".join(
        ch if ch in "+#" or unicodedata.category(ch)[0] in "LMN" else " " for ch in surface.lower()
    )
    return " ".join(kept.split())


def match_record(term: Term) -> dict:
    exact = term.alias_pos == 0
    return {
        "keyword": term.term,
        "matched_text": term.alias,
        "score": EXACT_SCORE if exact else ALIAS_SCORE,
        "match_type": "exact" if exact else "alias",
        "category": term.category,
        "weight": term.weight,
        "subcategory": term.subcategory,
    }


def form_places(forms: list[str]) -> Callable[[list[bytes]], Iterable[tuple[int, int, int]]]:
    """A function of texts that lists ``(text, form, at)``, all by number: each place where the words of a form stand, in order.

    All words of the texts are told at once, by their first letters and length, from those that begin no form.
    """
    words_of, places_of = words_finder(), word_places()
    #: First word -> forms of this word alone, and second word -> (form, further words).
    heads: dict[bytes, tuple[list[int], dict[bytes, list[tuple[int, list[bytes]]]]]] = {}
    for number, form in enumerate(forms):
        head, *rest = form.encode().split(b" ")
        alone, longer = heads.setdefault(head, ([], {}))
        if rest:
            longer.setdefault(rest[0], []).append((number, rest[1:]))
        else:
            alone.append(number)
    letters, bits, factor = 8, 16, np.uint64(0x9E3779B97F4A7C15)
    masks = np.array([(1 << 8 * n) - 1 for n in range(letters + 1)], np.uint64)

    def slots(coded: bytes, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        padded = coded + bytes(letters)
        eight = np.ndarray(len(coded) + 1, "<u8", padded, 0, (1,))[begins] & masks[np.minimum(sizes, letters)]
        return (((eight ^ sizes.astype(np.uint64)) * factor) >> np.uint64(64 - bits)).astype(np.int64)

    begun = np.zeros(1 << bits, np.bool_)
    for head in heads:
        begun[slots(head, np.array([0]), np.array([len(head)]))] = True

    def found(texts: list[bytes]) -> Iterable[tuple[int, int, int]]:
        coded = words_of(texts)
        begins, ends, first = places_of(coded)
        at = np.flatnonzero(begun[slots(coded, begins, ends - begins)])
        texts_at = np.searchsorted(first, at, "right") - 1
        following = np.minimum(at + 1, len(begins) - 1)
        spans = [a[i].tolist() for i in (at, following) for a in (begins, ends)]
        rows = zip(at.tolist(), texts_at.tolist(), first[texts_at].tolist(), first[texts_at + 1].tolist(), *spans)
        for i, text, start, stop, begin, end, next_begin, next_end in rows:
            known = heads.get(coded[begin:end])
            if known is None:
                continue
            alone, longer = known
            for form in alone:
                yield text, form, i - start
            if longer and i + 1 < stop:
                for form, rest in longer.get(coded[next_begin:next_end], ()):
                    last = i + 2 + len(rest)
                    if last <= stop and all(coded[begins[j] : ends[j]] == w for j, w in zip(range(i + 2, last), rest)):
                        yield text, form, i - start

    return found


class TermIndex:
    """A dictionary of bounded size, and the label patterns, matched in one pass per text."""

    def __init__(self, terms: Iterable[Term], labels: Iterable[str] = LABELS):
        self.terms = list(terms)
        forms: list[tuple[str, str, dict]] = []  # (dictionary or label, form, record)
        self.groups: dict[str, int] = {}  # dictionary or label -> number
        owners: list[int] = []  # form number -> number of its term
        seen: dict[tuple[str, str], int] = {}

        def add(group: str, key: str, form: str, record: dict) -> None:
            if not form:
                return
            owner = seen.setdefault((group, key), len(seen))
            forms.append((group, form, record))
            owners.append(owner)
            self.groups.setdefault(group, len(self.groups))

        by_dict: dict[str, list[Term]] = {}
        for term in self.terms:
            by_dict.setdefault(term.dict, []).append(term)
        for name, members in by_dict.items():
            by_term: dict[str, list[Term]] = {}
            for term in members:
                by_term.setdefault(term.term, []).append(term)
            for key, surfaces in by_term.items():
                used = set()
                for term in sorted(surfaces, key=lambda t: t.alias_pos):
                    form = plain_form(term.alias)
                    if form not in used:
                        used.add(form)
                        add(name, key, form, match_record(term))
        for label in labels:
            for phrase in token_forms(label):
                record = dict.fromkeys(_MATCH_FIELDS) | {"keyword": phrase}
                add(f"label:{label}", phrase, plain_form(phrase), record)
        if len(forms) > MAX_INDEX_FORMS:
            raise ValueError(
                f"{len(forms)} surface forms; use match_by_join beyond {MAX_INDEX_FORMS}"
            )

        self.names = list(by_dict)
        self.labels = list(labels)
        #: Form, number, owner, group, whether the group is a label's, and whether the term itself is the form.
        self._forms = [
            (form, number, owner, self.groups[group], group.startswith("label:"), record["score"] == EXACT_SCORE)
            for number, ((group, form, record), owner) in enumerate(zip(forms, owners))
        ]
        self._names = [record["keyword"] for _, _, record in forms]
        self._records = constant([record for _, _, record in forms], T.ArrayType(MATCH))

    @classmethod
    def builtin(cls, dictionaries: dict[str, dict] | None = None) -> TermIndex:
        return cls(flatten(dictionaries or DICTIONARIES))

    def _finder(self) -> Callable[[list[bytes]], list[list[list[int]]]]:
        """A function that lists the best surface form of every term in each text, by number, for each group.

        Those of a dictionary stand by score and in dictionary order, those of a label by the place where they first stand.
        """
        places, groups = form_places([form for form, *_ in self._forms]), len(self.groups)
        keywords = self._keywords()
        known = [(number, owner, group, labelled, exact) for _, number, owner, group, labelled, exact in self._forms]

        def best(found: dict[int, int]) -> list[list[int]]:
            out: list[list] = [[] for _ in range(groups)]
            others: list[tuple[int, int]] = []
            placed, before = set(), None
            for number, owner, group, labelled, exact in [known[f] for f in sorted(found)]:
                if owner != before:
                    if labelled:
                        placed.add(group)
                        out[group].append((found[number], keywords[number], number))
                    elif exact:
                        out[group].append(number)
                    else:
                        others.append((group, number))
                before = owner
            for group, number in others:
                out[group].append(number)
            for group in placed:
                out[group] = [number for _, _, number in sorted(out[group])]
            return out

        def listed(texts: list[bytes]) -> list[list[list[int]]]:
            found: list[dict[int, int]] = [{} for _ in texts]
            for text, form, at in places(texts):
                found[text].setdefault(form, at)
            return [best(f) for f in found]

        return listed

    def _keywords(self) -> list[bytes]:
        """Keywords by the number of the form, as Spark puts texts in order."""
        return [keyword.encode() for keyword in self._names]

    @classmethod
    def holds(cls, terms: DataFrame) -> bool:
        """The dictionary is small enough for a literal."""
        return terms.limit(MAX_INDEX_FORMS + 1).count() <= MAX_INDEX_FORMS // 2

    def _matches(self, found: Column, group: str) -> Column:
        """The match records of a group in the order they were listed."""
        if group not in self.groups:
            return F.array().cast(T.ArrayType(MATCH))
        return F.transform(F.get(found, F.lit(self.groups[group])), lambda number: F.get(self._records, number))

    def _labelled(self, found: Column, label: str) -> Column:
        """Phrases of a label in the order of their first occurrence."""
        return F.transform(self._matches(found, f"label:{label}"), lambda r: r["keyword"])

    def match(self, text: Column) -> Column:
        """Struct with one array of match records per dictionary and one of phrases per label.

        Also ``seniority_levels``, the seniority matches, when their dictionary is there.
        """

        # The same call in every field is made once, and only the fields that are read are built.
        found = per_batch(self._finder(), "array<array<int>>", null=b"")(text)
        matches = {name: self._matches(found, name) for name in self.names}
        if SENIORITY_DICT in matches:
            matches["seniority_levels"] = seniority(matches[SENIORITY_DICT])
        for label in self.labels:
            matches[f"label_{label}"] = self._labelled(found, label)
        return F.struct(*[value.alias(name) for name, value in matches.items()])


def seniority(matches: Column) -> Column:
    """Matches whose group is a seniority group."""
    return F.filter(
        matches,
        lambda m: F.contains(m["category"], F.lit(SENIORITY_MARKS[0]))
        | F.contains(m["category"], F.lit(SENIORITY_MARKS[1])),
    )


def keyword_confidence(lists: list[Column], total: Column) -> Column:
    """Weighted mean score plus a bonus for diverse groups, at most 1; 0 without scored matches."""

    def score(matches: Column) -> Column:
        weights = F.aggregate(matches, F.lit(0.0), lambda a, m: a + m["weight"])
        weighted = F.aggregate(matches, F.lit(0.0), lambda a, m: a + m["score"] * m["weight"])
        groups = F.size(F.array_distinct(F.transform(matches, lambda m: m["category"])))
        bonus = F.least(groups / 10.0, F.lit(0.2))
        return F.when(weights == 0, F.lit(0.0)).otherwise(
            F.least(weighted / weights + bonus, F.lit(1.0))
        )

    return F.when(total == 0, F.lit(0.0)).otherwise(let(F.concat(*lists), score))


def top_matches(lists: dict[str, Column], limit: int = 10) -> Column:
    """Best matches over several dictionaries, tagged with the dictionary they come from."""

    def with_name(matches: Column, name: str) -> Column:
        return F.transform(
            matches,
            lambda m: F.struct(
                *[m[f].alias(f) for f in _MATCH_FIELDS], F.lit(name).alias("match_category")
            ),
        )

    every = F.concat(*[with_name(matches, name) for name, matches in lists.items()])
    ranked = F.array_sort(
        F.transform(
            every, lambda m, i: F.struct((-m["score"]).alias("rank"), i.alias("i"), m.alias("m"))
        )
    )
    return F.slice(F.transform(ranked, lambda r: r["m"]), 1, limit)


def long_matches(df: DataFrame, key: str, text: str, index: TermIndex) -> DataFrame:
    """One row per text and matched term of a bounded dictionary."""
    row = df.select(key, index.match(F.col(text)).alias("m"))
    every = F.concat(*[tagged(F.col(f"m.{name}"), name, "dict", "match") for name in index.names])
    return row.select(key, F.explode(every).alias("e")).select(key, "e.dict", "e.match.*")


def label_places(df: DataFrame, key: str, text: str, labels: Iterable[str] = LABELS) -> DataFrame:
    """``(key, label, phrase, at)``: every place where a label's phrase stands, by the number of its first word.

    The first place of each phrase gives the order in which ``TermIndex.match`` lists them.
    """
    rows = [(label, plain_form(phrase), phrase) for label in labels for phrase in token_forms(label)]
    places, shift = form_places([form for _, form, _ in rows]), PLACE_BITS

    def listed(texts: list[bytes]) -> list[list[int]]:
        found: list[list[int]] = [[] for _ in texts]
        for text, form, at in places(texts):
            found[text].append(form << shift | at)
        return found

    known = constant([{"label": label, "phrase": phrase} for label, _, phrase in rows], "array<struct<label:string,phrase:string>>")
    codes = df.select(key, F.explode(per_batch(listed, "array<bigint>", null=b"")(F.col(text))).alias("code"))
    named = F.get(known, F.shiftright("code", PLACE_BITS).cast("int")).alias("named")
    at = F.col("code").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("at")
    return codes.select(key, named, at).select(key, "named.label", "named.phrase", "at")


def match_by_join(
    df: DataFrame, key: str, text: str, terms: DataFrame, *, whole_phrases: bool = False
) -> DataFrame:
    """``long_matches`` for a dictionary given as a table of ``schemas.TERM`` rows.

    Words of the texts meet the first words of the forms, and the whole form is looked up in the
    text at hand; the planner broadcasts a dictionary that is small in bytes.  With
    ``whole_phrases`` the texts' phrases, which carry no text along, are joined instead: for
    dictionaries too large to broadcast.  Only phrases whose hash may be that of a form become
    rows, so aliases of any length cost their place a look.  Only matches are grouped.
    """
    forms = terms.withColumn("form", match_form(F.col("alias"))).where("form != ''")
    texts = df.select(key, match_form(F.col(text)).alias("t"))
    group = [key, "dict", F.col("term").alias("keyword")]
    if whole_phrases:
        known = _ranked_forms(forms)
        gate = PhraseGate(known.select(match_form(F.col("alias")).alias("form")))
        # Phrases and forms may be long, so they meet by their hashes.
        found = phrases(texts, key, "t", gate.counts, gate).select(key, _digest("phrase"))
        hits = found.join(known.select("digest", "dict", "term", "rank", "_form_id"), "digest")
        best = hits.groupBy(*group).agg(F.min(F.struct("rank", "_form_id"))["_form_id"].alias("_form_id"))
        best = best.join(known.select("_form_id", F.struct(*_FORM).alias("b")), "_form_id")
    else:
        heads = forms.withColumn("head", F.substring_index("form", " ", 1))
        words = texts.select(key, "t", F.explode(F.array_distinct(F.split("t", " "))).alias("head"))
        padded, needle = [F.concat(F.lit(" "), c, F.lit(" ")) for c in ("t", "form")]
        hits = words.join(heads, "head").where(F.contains(padded, needle))
        best = hits.groupBy(*group).agg(F.min_by(F.struct(*_FORM), F.struct(*_FORM_ORDER)).alias("b"))
    exact = F.col("b.alias_pos") == 0
    return best.select(
        key,
        "dict",
        "keyword",
        F.col("b.alias").alias("matched_text"),
        F.when(exact, F.lit(EXACT_SCORE)).otherwise(F.lit(ALIAS_SCORE)).alias("score"),
        F.when(exact, F.lit("exact")).otherwise(F.lit("alias")).alias("match_type"),
        "b.category",
        "b.weight",
        "b.subcategory",
    )


_FORM = ["alias", "alias_pos", "category", "weight", "subcategory"]
#: The first of a term's surface forms in a text counts.
_FORM_ORDER = ["alias_pos", "category", "alias"]


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary"))).alias("digest")


def _ranked_forms(forms: DataFrame) -> DataFrame:
    """The forms of each term, once each, with their ``digest``, a ``_form_id`` and their ``rank`` in the term; written."""
    first = F.min_by(F.struct(*_FORM), F.struct(*_FORM_ORDER))
    once = forms.groupBy("form", "dict", "term").agg(first.alias("b")).select("dict", "term", "b.*", _digest("form"))
    rank = F.row_number().over(Window.partitionBy("dict", "term").orderBy(*_FORM_ORDER))
    return materialize(once.withColumns({"rank": rank, "_form_id": F.monotonically_increasing_id()}), "surface-forms")


def by_dictionary(rows: DataFrame, key: str) -> DataFrame:
    """``(key, matches)``: the matches of each text as a map from dictionary to an array.

    Best score first, then by group and keyword.
    """
    match = F.struct(*[F.col(f).cast(MATCH[f].dataType).alias(f) for f in _MATCH_FIELDS])
    ordered = F.struct((-F.col("score")).alias("s"), "category", "keyword", match.alias("m"))
    # Dealt once for both groupings and the join that follows.
    one = rows.repartition(F.col(key)).groupBy(key, "dict").agg(F.sort_array(F.collect_list(ordered)).alias("o"))
    entry = F.struct("dict", F.transform("o", lambda x: x["m"]).alias("found"))
    return one.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("matches"))
