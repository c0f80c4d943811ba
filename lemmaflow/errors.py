"""Errors of the package. Messages never hold input text."""


class LemmaflowError(Exception):
    """Base of all errors here."""


class InvalidOptions(LemmaflowError, ValueError):
    """Options, files or sizes that can't be used."""


class ParseError(LemmaflowError):
    """Analyzer output that isn't what it should be."""


class TokenizationError(LemmaflowError):
    """Tokens that don't fit their text."""


class EngineError(LemmaflowError):
    """An analyzer that can't be found, started or used."""


class EngineNotFound(EngineError):
    """No executable."""


class EngineStartup(EngineError):
    """The process didn't start."""


class EngineTimeout(EngineError):
    """No answer in time."""


class EngineOutputLimit(EngineError):
    """More output than allowed."""


class EngineProcess(EngineError):
    """The process ended badly; keeps the exit code and the last of its diagnostics."""

    def __init__(self, message: str, exit_code: int | None = None, stderr: str = ""):
        super().__init__(message)
        self.exit_code, self.stderr = exit_code, stderr[-2000:]


class EngineProtocol(EngineError):
    """The answer doesn't follow the protocol."""


class EngineClosed(EngineError):
    """Used after it was closed or had failed for good."""


class EnginePoolExhausted(EngineError):
    """No free session in time."""


class AnswerError(LemmaflowError):
    """A request that failed where its document was analyzed; the message names the error."""
