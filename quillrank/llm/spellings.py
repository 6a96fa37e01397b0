"""Typed names of organisations to what they name: legal form, place and remarks off, kind words recognised."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from quillrank.llm.tries import Trie

# Words that say what kind of organisation a name belongs to.
COMPANY_KINDS = ["technologies", "systems", "solutions", "services", "analytics", "laboratories", "software", "industries", "consulting", "logistics", "networks", "foods", "motors", "insurance", "retail", "textiles", "healthcare", "media", "energy", "finance"]
SCHOOL_KINDS = ["institute", "technology", "university", "college", "engineering", "science", "management", "school", "business", "womens", "commerce", "polytechnic", "national", "design"]
KINDS = {"company": COMPANY_KINDS, "institution": SCHOOL_KINDS}
# Short forms that are no cut or squeezed form of their word.
SHORT_FORMS = {
    "company": {"it": "technologies", "infotech": "technologies", "tech": "technologies", "techs": "technologies", "techno": "technologies", "technology": "technologies", "health": "healthcare", "care": "healthcare", "labs": "laboratories", "lab": "laboratories", "insurers": "insurance", "consultants": "consulting", "consultancy": "consulting", "industrial": "industries", "industry": "industries", "financial": "finance", "inds": "industries", "sw": "software", "softwares": "software"},
    "institution": {"univ": "university", "uni": "university", "varsity": "university", "mgmt": "management", "mgt": "management", "tech": "technology", "engg": "engineering", "engr": "engineering", "clg": "college", "collage": "college", "sch": "school", "schl": "school", "poly": "polytechnic", "inst": "institute", "instt": "institute", "women": "womens", "woman": "womens", "natl": "national", "nat": "national", "nal": "national", "sci": "science", "sc": "science", "comm": "commerce", "com": "commerce", "bus": "business", "biz": "business", "dsgn": "design", "des": "design"},
}
LEGAL = ("pvt", "private", "ltd", "limited", "inc", "incorporated", "llp", "llc", "plc", "corp", "corporation", "co", "company", "gmbh", "ag", "sa", "bv", "pty", "pte")
REMARKS = ("office", "campus", "branch", "main", "autonomous", "hq", "headquarters", "deemed", "the", "of", "and", "for", "at", "in", "n")
PLACES = ("india", "usa", "uk", "canada", "germany", "chennai", "jaipur", "hyderabad", "toronto", "indore", "pune", "kochi", "austin", "ahmedabad", "noida", "bengaluru", "bangalore", "berlin", "mumbai", "leeds", "kolkata", "gurugram", "gurgaon", "delhi", "london", "singapore", "dubai", "boston", "chicago", "dallas", "seattle", "munich", "hamburg", "vancouver", "montreal", "manchester", "lucknow", "bhopal", "nagpur", "surat", "coimbatore", "mysuru", "chandigarh")
NO_ORGANISATION = ["selfemployed", "freelance", "freelancer", "freelancing", "confidential", "undisclosed", "notdisclosed", "stealthstartup", "stealth", "startup", "stealthmode", "na", "none", "nil", "null", "unknown", "notapplicable", "various", "independent", "unemployed", "careerbreak", "homeschooled", "tbd", "other", "others", "selftaught"]

_SPECIAL = str.maketrans({"ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "œ": "oe", "ł": "l", "Ł": "L", "đ": "d", "ı": "i"})


def folded(text: str) -> str:
    """Without accents and full-width forms; letters' case is kept."""
    text = unicodedata.normalize("NFKD", text.translate(_SPECIAL))
    return "".join(c for c in text if not unicodedata.combining(c))


def tokens(text: str) -> list[str]:
    """Lower-case words; words glued together at a capital letter are parted, possessives joined."""
    text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", folded(text))
    text = re.sub(r"['’`]", "", text.lower())
    return re.findall(r"[a-z0-9]+", text)


@lru_cache(None)
def _known(field: str) -> tuple[Trie, dict[str, str]]:
    """A trie of the kind words and their singulars, and the word of each."""
    words = {w: w for w in KINDS[field]}
    for w in KINDS[field]:
        if w.endswith("ies"):
            words.setdefault(w[:-3] + "y", w)
        elif w.endswith("s") and not w.endswith("ss"):
            words.setdefault(w[:-1], w)
    return Trie(words), words


@lru_cache(None)
def _short(field: str) -> Trie:
    return Trie(s for s in SHORT_FORMS[field] if len(s) >= 4)


@lru_cache(1 << 16)
def kind_word(token: str, field: str) -> str | None:
    """The kind word a token is, misspelt or cut short, or None."""
    trie, words = _known(field)
    if token in words:
        return words[token]
    if token in SHORT_FORMS[field]:
        return SHORT_FORMS[field][token]
    n = len(token)
    if n >= 4:
        near = sorted((d, words[w]) for w, d in trie.near(token, 2 if n >= 7 else 1) if n > 4 or len(w) > 4)
        if near:
            return near[0][1]
    if 3 <= n <= 8:
        short = [w for w in KINDS[field] if n < len(w) and w[0] == token[0] and (w.startswith(token) or _squeezed(token, w))]
        if short:
            return min(short, key=lambda w: (not w.startswith(token), len(w)))
    if n >= 4:
        near = sorted((d, SHORT_FORMS[field][s]) for s, d in _short(field).near(token, 1))
        if near:
            return near[0][1]
    if n >= 5 and sum(c in "aeiou" for c in token) <= 1:
        # A squeezed form with one letter too many.
        short = [w for w in KINDS[field] if n <= len(w) and any(w[0] == x[0] and _squeezed(x, w) for x in (token[:k] + token[k + 1 :] for k in range(1, n)))]
        if short:
            return min(short, key=len)
    return None


def _squeezed(short: str, word: str) -> bool:
    """True if ``short`` is ``word`` with letters left out, vowels above all: txtls, ntwks, consltg."""
    at = 0
    for c in word:
        if at < len(short) and short[at] == c:
            at += 1
    if at < len(short):
        return False
    kept, there = sum(c in "aeiou" for c in short[1:]), sum(c in "aeiou" for c in word[1:])
    return kept * 2 <= there and len(short) >= 3


@lru_cache(None)
def _nothing() -> Trie:
    return Trie(NO_ORGANISATION)


@lru_cache(None)
def _long(words: tuple[str, ...]) -> Trie:
    return Trie(w for w in words if len(w) >= 6)


@lru_cache(1 << 16)
def _is_near(token: str, words: tuple[str, ...]) -> bool:
    return token in words or (len(token) >= 6 and any(True for _ in _long(words).near(token, 1)))


@lru_cache(1 << 16)
def _parted(token: str, field: str) -> tuple[str, ...]:
    """A token that ends or begins with a whole kind word, parted there."""
    for w in KINDS[field]:
        if len(w) >= 5 and len(token) - len(w) >= 4:
            if token.endswith(w):
                return token[: -len(w)], w
            if token.startswith(w):
                return w, token[len(w) :]
    # A misspelt kind word with "of" glued to it begins a name: universittyof...
    at = token.find("of", 5)
    if 0 < at <= 13 and (len(token) == at + 2 or len(token) - at >= 6) and kind_word(token[:at], field):
        return (token[:at], token[at + 2 :]) if len(token) > at + 2 else (token[:at],)
    return (token,)


def parse_name(name: str, field: str) -> tuple[str, str, list[str], str]:
    """(kind, letters, words, initials) of a name.

    ``kind`` has its kind words, ``letters`` those of a bare abbreviation, ``words`` what else names it, and
    ``initials`` the first letters of words and kind words in the order written. All are empty where the text
    names no organisation.
    """
    bare = re.sub(r"\([^()]*\)", " ", name).strip(" .,-_/|\t\r\n ")
    letters = re.sub(r"[.\s]", "", folded(bare))
    if 2 <= len(letters) <= 6 and letters.isalpha() and (letters.isupper() and " " not in bare or re.fullmatch(r"(?:[A-Za-z]\.){1,5}[A-Za-z]?", bare)):
        return "", letters.lower(), [], letters.lower()
    found = tokens(bare)
    if "".join(found) in NO_ORGANISATION:
        return "", "", [], ""
    kinds, words, initials = [], [], ""
    for t in found:
        if _is_near(t, LEGAL) or t in REMARKS:
            continue
        for part in (t,) if kind_word(t, field) else _parted(t, field):
            kind = kind_word(part, field)
            if kind:
                kinds.append(kind)
                initials += kind[0]
            elif len(part) > 1 and not _is_near(part, PLACES) and not _is_near(part, REMARKS[:8]):
                words.append(part)
                initials += part[0]
    whole = "".join(words)
    if not whole or whole in NO_ORGANISATION or (len(whole) >= 6 and any(True for _ in _nothing().near(whole, 1))):
        return "", "", [], ""
    return "+".join(sorted(set(kinds))), "", words, initials
