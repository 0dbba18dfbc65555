"""Languages by file extension, and the check of one whole text."""

from __future__ import annotations

from importlib import import_module

from lodestone.llm.syntax.engine import Language

# fixed values: extension to language
EXTENSIONS = {"py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "go": "go", "java": "java", "rs": "rust"}
_MODULES = {"javascript": "ecma", "typescript": "ecma", "go": "golang", "java": "java", "rust": "rust", "python": "python"}


class _Languages(dict):
    """Grammars are compiled when a text of their language first comes: tasks that only pass verdicts on need none."""

    def __missing__(self, name: str) -> Language:
        self[name] = getattr(import_module(f"lodestone.llm.syntax.{_MODULES[name]}"), name.upper())
        return self[name]


LEXED: dict[str, Language] = _Languages()


def language_of(path: str | None) -> str | None:
    return EXTENSIONS.get(path.rpartition("/")[2].rpartition(".")[2].lower()) if path and "." in path else None


def body(text: str, language: str) -> str:
    """The text without a byte order mark and, where the language allows one, an interpreter line."""
    text = text.removeprefix("﻿")
    if text.startswith("#!") and (language in ("javascript", "typescript") or language == "rust" and not text.startswith("#![")):
        text = "\n" + text.partition("\n")[2]
    if language == "python" and "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text


def valid(text: str, language: str) -> bool:
    """Whether a whole text, as one chunk, is a program."""
    return LEXED[language].valid(body(text, language))
