"""What can go wrong, and how it is told: every one of these ends a run with 2."""

from __future__ import annotations

import re
from contextlib import contextmanager

#: What errors inside of Spark tasks begin with, so that they are known again outside.
BAD_JSON, BAD_SOURCE, BAD_FILE = "unreadable JSON document", "unreadable Rust source", "unreadable file"


class RiskError(Exception):
    pass


class CommandError(RiskError):
    def __init__(self, tool: str, status):
        super().__init__(f"`{tool}` failed with status {status}")


class ToolNotFound(RiskError):
    def __init__(self, tool: str):
        super().__init__(f"no `{tool}` here; the tool chain's component llvm-tools provides it")


class JsonError(RiskError):
    def __init__(self, why):
        super().__init__(f"{BAD_JSON}: {why}")


class ParseError(RiskError):
    def __init__(self, file: str, why):
        super().__init__(f"{BAD_SOURCE} {file}: {why}")


class FileError(RiskError):
    def __init__(self, file: str, why):
        super().__init__(f"{BAD_FILE} {file}: {why}")


class NoTestBinaries(RiskError):
    def __init__(self):
        super().__init__("the test build made no test programs")


class NoProfiles(RiskError):
    def __init__(self):
        super().__init__("the test programs left no raw profiles behind")


class ArgumentError(RiskError):
    pass


def told(error: Exception) -> RiskError | None:
    """The error of this module that an exception of Spark stands for, if any."""
    text = str(error)
    for mark, kind in ((BAD_SOURCE, ParseError), (BAD_FILE, FileError)):
        if m := re.search(rf"{mark} (.+?): ([^\n]*)", text):
            return kind(m[1], m[2])
    if m := re.search(rf"{BAD_JSON}: ([^\n]*)", text):
        return JsonError(m[1])
    if "MALFORMED_RECORD" in text or "FAILED_READ_FILE" in text:
        return JsonError("it doesn't have the form of a coverage export")
    return None


@contextmanager
def translated():
    """Tells errors of Spark tasks as those of this module."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        yield
    except (PySparkException, Py4JJavaError, RuntimeError) as e:
        known = told(e)
        if known is None:
            raise
        raise known from None
