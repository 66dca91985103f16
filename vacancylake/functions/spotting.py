"""Skills, technologies and roles found without a dictionary.

Two modes, as in ``SPOTTING_MODES``: token patterns with labels (matched by
``operators.term_match``) plus phrases after a context, or plain substrings.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacancylake.functions.arrays import empty_strings, size0
from vacancylake.functions.text import SPACE, computed_once, per_batch, strip

SPOTTING_MODES = ("patterns", "substring")
LABELS = ["skills", "roles", "technologies", "responsibilities", "qualifications"]

# Token sequences per label, one list of alternatives per token.
TOKEN_PATTERNS: dict[str, list[list[list[str]]]] = {
    "skills": [
        [["python", "java", "javascript", "c++", "c#", "php", "ruby", "go", "rust", "swift"]],
        [["machine"], ["learning"]],
        [["data"], ["science"]],
        [["artificial"], ["intelligence"]],
        [["deep"], ["learning"]],
        [["natural"], ["language"], ["processing"]],
        [["computer"], ["vision"]],
        [["big"], ["data"]],
        [["data"], ["analysis"]],
        [["data"], ["visualization"]],
        [["problem"], ["solving"]],
        [["critical"], ["thinking"]],
        [["team"], ["work"]],
        [["communication"], ["skills"]],
        [["leadership"]],
        [["project"], ["management"]],
        [["time"], ["management"]],
    ],
    "roles": [
        [["developer", "engineer", "programmer", "architect", "analyst", "scientist"]],
        [["software"], ["developer", "engineer"]],
        [["data"], ["scientist", "engineer", "analyst"]],
        [["machine"], ["learning"], ["engineer"]],
        [["full"], ["stack"], ["developer"]],
        [["frontend"], ["developer"]],
        [["backend"], ["developer"]],
        [["devops"], ["engineer"]],
        [["product"], ["manager"]],
        [["project"], ["manager"]],
        [["tech"], ["lead"]],
        [["team"], ["lead"]],
    ],
    "technologies": [
        [["react", "angular", "vue", "django", "flask", "spring", "laravel", "express"]],
        [["react"], ["js"]],
        [["node"], ["js"]],
        [["vue"], ["js"]],
        [["mysql", "postgresql", "mongodb", "redis", "elasticsearch", "cassandra"]],
        [["sql"], ["server"]],
        [["aws", "azure", "gcp", "docker", "kubernetes"]],
        [["amazon"], ["web"], ["services"]],
        [["google"], ["cloud"], ["platform"]],
        [["git", "jenkins", "jira", "confluence", "slack", "tableau", "powerbi"]],
    ],
    "responsibilities": [
        [["develop", "design", "implement", "maintain", "create", "build"]],
        [["work"], ["with"]],
        [["collaborate"], ["with"]],
        [["responsible"], ["for"]],
        [["manage"]],
        [["lead"]],
        [["coordinate"]],
        [["ensure"]],
        [["support"]],
        [["participate"], ["in"]],
    ],
    "qualifications": [
        [["bachelor"], ["degree"]],
        [["master"], ["degree"]],
        [["phd"]],
        [["years", "year"], ["experience"]],
        [["experience"], ["in"]],
        [["knowledge"], ["of"]],
        [["familiar"], ["with"]],
        [["proficient"], ["in"]],
        [["expert"], ["in"]],
    ],
}

# Substrings looked for in the substring mode, in reporting order.
SUBSTRINGS: dict[str, list[str]] = {
    "skills": [
        "python", "java", "javascript", "react", "angular", "vue", "machine learning",
        "data science", "sql", "git", "docker", "aws", "azure", "kubernetes", "teamwork",
        "leadership", "communication", "problem solving",
    ],
    "technologies": [
        "react", "angular", "vue", "django", "flask", "spring", "mysql", "postgresql",
        "mongodb", "redis", "docker", "kubernetes", "aws", "azure", "git", "jenkins",
    ],
    "roles": [
        "developer", "engineer", "analyst", "scientist", "manager", "architect", "lead",
        "senior", "junior", "intern",
    ],
}

# Phrases that introduce skills, and words that are no skill.
SKILL_CONTEXTS = [
    "experience with", "knowledge of", "proficient in", "skilled in", "expert in",
]
NO_SKILL = ["and", "or", "the", "of", "in", "to", "for"]
#: How many skills of a context count; the rest of the sentence is seldom a list.
SKILLS_PER_CONTEXT = 3
MIN_SKILL_LENGTH = 3


def token_forms(label: str) -> list[str]:
    """The token sequences of a label written out as phrases."""
    forms = []
    for tokens in TOKEN_PATTERNS[label]:
        phrases = [""]
        for alternatives in tokens:
            phrases = [f"{p} {a}".strip() for p in phrases for a in alternatives]
        forms.extend(phrases)
    return forms


def substring_finder(keywords: list[str]) -> Callable[[list[bytes]], list[list[str]]]:
    """A function of texts that lists which of the keywords, in lower-case ASCII, each holds in lower case, in their order."""
    coded = [(k.encode(), k) for k in keywords]
    # of the characters beyond ASCII these have ASCII letters in lower case
    special = [(c.encode(), c.lower().encode()) for c in "\u212aİ"]

    def found(texts: list[bytes]) -> list[list[str]]:
        out = []
        for t in texts:
            low = t.lower()
            for c, small in special:
                if c in low:
                    low = low.replace(c, small)
            out.append([k for b, k in coded if b in low])
        return out

    return found


def substrings(text: Column, kind: str) -> Column:
    """Keywords of a kind contained anywhere in the text, in keyword order."""
    return per_batch(substring_finder(SUBSTRINGS[kind]), "array<string>", null=b"")(computed_once(text))


def _skills_after(sentence: Column, context: str, limit: int | None) -> Column:
    tail = F.regexp_extract(sentence, rf"(?U){context}[{SPACE}]+([^.]+)", 1)
    items = F.transform(F.split(tail, r"(?U)[,;]|\band\b"), strip)
    kept = F.filter(
        items, lambda i: (F.length(i) >= MIN_SKILL_LENGTH) & ~i.isin(NO_SKILL)
    )
    return kept if limit is None else F.slice(kept, 1, limit)


def contextual_skills(text: Column, limit: int | None = SKILLS_PER_CONTEXT) -> Column:
    """Up to ``limit`` phrases after each context, per sentence; all of them where it is None."""
    lowered = F.lower(text)
    sentences = F.split(lowered, rf"(?U)(?<=[.!?])[{SPACE}]+")

    def skills(sentence: Column) -> Column:
        return F.concat(
            *[F.when(F.contains(sentence, F.lit(c)), _skills_after(sentence, c, limit)).otherwise(empty_strings()) for c in SKILL_CONTEXTS]
        )

    hits = F.flatten(F.transform(sentences, skills))
    gate = reduce(Column.__or__, [F.contains(lowered, F.lit(c)) for c in SKILL_CONTEXTS])
    return F.when(gate, hits).otherwise(empty_strings())


def pattern_confidence(lists: list[Column]) -> Column:
    """Confidence from the number of extractions and how many of the lists hold any."""
    total = reduce(Column.__add__, [size0(c) for c in lists])
    kinds = reduce(Column.__add__, [(size0(c) > 0).cast("int") for c in lists])
    score = F.least(total / 10.0, F.lit(1.0)) + kinds / 6.0 * 0.2
    return F.when(total == 0, F.lit(0.0)).otherwise(F.least(score, F.lit(1.0)))


SUBSTRING_CONFIDENCE = 0.5
