"""Typed errors with stable codes, and the exit codes of the command line."""

from __future__ import annotations


class GalleyError(Exception):
    """An error with a code that reports carry, and a message without paths or contents."""

    code, exit_code = "internal", 1

    def as_dict(self) -> dict:
        return {"code": self.code, "message": str(self)}


class InvalidOptions(GalleyError):
    code, exit_code = "invalid_options", 2


class InputMissing(GalleyError):
    code, exit_code = "input_missing", 3


class InputMalformed(GalleyError):
    code, exit_code = "input_malformed", 4


class InputUnsupported(GalleyError):
    code, exit_code = "input_unsupported", 5


class LimitExceeded(GalleyError):
    code, exit_code = "limit_exceeded", 6


class RenderFailed(GalleyError):
    code, exit_code = "render_failed", 7


class OutputFailed(GalleyError):
    code, exit_code = "output_failed", 8


EXIT_CODES = {c.code: c.exit_code for c in (GalleyError, InvalidOptions, InputMissing, InputMalformed, InputUnsupported, LimitExceeded, RenderFailed, OutputFailed)}


def safe(error: BaseException) -> dict:
    """Code and message of any error; what is not a GalleyError says its type alone."""
    return error.as_dict() if isinstance(error, GalleyError) else {"code": GalleyError.code, "message": type(error).__name__}
