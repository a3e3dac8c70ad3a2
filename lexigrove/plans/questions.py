"""Filters in plain questions: years, languages, file types, folders, tags, sites. English and German."""

from __future__ import annotations

import re

from lexigrove.operators.filters import SearchFilters

#: Language names after "in" or "auf".
NAMES = {"german": "de", "deutsch": "de", "english": "en", "englisch": "en", "french": "fr", "französisch": "fr", "spanish": "es", "spanisch": "es", "italian": "it", "italienisch": "it", "bosnian": "bs", "bosnisch": "bs", "croatian": "hr", "kroatisch": "hr", "serbian": "sr", "serbisch": "sr", "turkish": "tr", "türkisch": "tr", "arabic": "ar", "arabisch": "ar", "japanese": "ja", "japanisch": "ja", "chinese": "zh", "chinesisch": "zh", "russian": "ru", "russisch": "ru", "portuguese": "pt", "portugiesisch": "pt", "dutch": "nl", "niederländisch": "nl", "polish": "pl", "polnisch": "pl", "korean": "ko", "koreanisch": "ko"}
TYPES = {"pdf": "pdf", "docx": "docx", "word": "docx", "mp3": "mp3", "mp4": "mp4", "epub": "epub", "markdown": "md", "md": "md", "txt": "txt", "html": "html"}
YEAR = r"(1[89]\d\d|20\d\d|2100)"


def parse_question(text: str) -> tuple[str, SearchFilters]:
    """What is left of the question, and the filters that its parts set."""
    found = SearchFilters()

    def take(pattern: str, use) -> None:
        nonlocal text
        if m := re.search(pattern, text, re.IGNORECASE):
            use(m)
            text = text[: m.start()] + " " + text[m.end() :]

    def years(low: str | None, high: str | None) -> None:
        found.year_min = int(low) if low else found.year_min
        found.year_max = int(high) if high else found.year_max

    take(rf"\b{YEAR}\s*[-–]\s*{YEAR}\b", lambda m: years(m[1], m[2]))
    take(rf"\b(?:from|since|after|ab|seit)\s+{YEAR}\b", lambda m: years(m[1], None))
    take(rf"\b(?:before|until|bis|vor)\s+{YEAR}\b", lambda m: years(None, m[1]))
    take(rf"\b(?:in|auf)\s+({'|'.join(NAMES)})\b", lambda m: setattr(found, "language", NAMES[m[1].lower()]))
    take(rf"(?:\.|\b)({'|'.join(TYPES)})(?:s|\s+files|-dokumente|\s+dateien)\b|\.({'|'.join(TYPES)})\b", lambda m: setattr(found, "extensions", [TYPES[(m[1] or m[2]).lower()]]))
    take(r"\b(?:folder|ordner):?\s+(\S+)", lambda m: setattr(found, "folder_prefix", m[1]))
    take(r"\b(?:tag|tagged|schlagwort):?\s+(\S+)", lambda m: found.tags.append(m[1]))
    take(r"\b(?:site|domain|von der seite):?\s+(\S+\.\S+)", lambda m: setattr(found, "url", m[1]))
    return " ".join(text.split()), found
