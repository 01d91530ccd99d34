"""Errors with a hint each."""

from __future__ import annotations


class VeilError(Exception):
    hint = ""

    def __init__(self, message: str, hint: str | None = None) -> None:
        super().__init__(message)
        self.message, self.hint = message, self.hint if hint is None else hint


class MissingFileError(VeilError, FileNotFoundError):
    hint = "Check the path, and that every executor can read it."


class UnsupportedFormatError(VeilError, ValueError):
    hint = "Known formats: csv, tsv, json, jsonl, parquet, orc, xml, text, avro, excel (xlsx)."


class NoPersonalDataError(VeilError):
    hint = "Name the fields in a policy, or lower the confidence threshold."


class AccessError(VeilError, PermissionError):
    hint = "Check the rights on the path."


class PolicyError(VeilError, ValueError):
    hint = "A rule is a dict with a strategy: replace, hash, mask or remove."


class EmptyDataError(VeilError, ValueError):
    hint = "The input has no rows."


class MissingFeatureError(VeilError, ImportError):
    hint = "The feature needs a library or jar that isn't here."


class BudgetExceededError(VeilError):
    hint = "Ask fewer queries, spend less on each, or reset the budget."


_BUILTIN = ((FileNotFoundError, MissingFileError), (PermissionError, AccessError), (ModuleNotFoundError, MissingFeatureError))


def format_error(error: BaseException) -> str:
    """One message for users; errors of the operating system get the hint of their kind."""
    if isinstance(error, VeilError):
        return f"Error: {error.message}" + (f"\nHint: {error.hint}" if error.hint else "")
    for builtin, own in _BUILTIN:
        if isinstance(error, builtin):
            return f"Error: {error}\nHint: {own.hint}"
    return f"Error: {type(error).__name__}: {error}"
