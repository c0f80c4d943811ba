"""Options, checked when they are made; derive others with dataclasses.replace."""

from __future__ import annotations

import os
from dataclasses import dataclass
from enum import StrEnum

from lemmaflow.errors import InvalidOptions


class OutputFormat(StrEnum):
    TEXT = "text"
    XML = "xml"
    JSON = "json"


class Encoding(StrEnum):
    CP866 = "cp866"
    CP1251 = "cp1251"
    KOI8_R = "koi8-r"
    UTF_8 = "utf-8"


class ExecutionMode(StrEnum):
    ONE_SHOT_TEXT = "ONE_SHOT_TEXT"
    ONE_SHOT_FILE = "ONE_SHOT_FILE"
    SESSION = "SESSION"
    POOL = "POOL"


class ExecutionProfile(StrEnum):
    UNKNOWN = "UNKNOWN"
    PROCESS_PER_REQUEST = "ONE_SHOT_PROCESS_PER_REQUEST"
    REUSABLE_SESSION = "REUSABLE_SESSION"
    POOLED_SESSIONS = "POOLED_SESSIONS"


class UnmatchedPolicy(StrEnum):
    SYNTHESIZE = "SYNTHESIZE_FROM_ORIGINAL_TEXT"
    FAIL = "FAIL"


class LemmaPolicy(StrEnum):
    ALL = "ALL"
    BEST_WEIGHT = "BEST_WEIGHT"


class PositionPolicy(StrEnum):
    COMPACT = "COMPACT"
    PRESERVE = "PRESERVE_SKIPPED_TOKENS"


class ClientPolicy(StrEnum):
    ALLOW_ANY = "ALLOW_ANY"
    WARN = "WARN_ON_KNOWN_SLOW_CLIENTS"
    REQUIRE_POOLED = "REQUIRE_POOLED_OR_UNKNOWN"


class OversizedPolicy(StrEnum):
    FAIL = "FAIL"
    TRUNCATE = "TRUNCATE"


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise InvalidOptions(message)


@dataclass(frozen=True)
class TokenizerOptions:
    """What search tokens are told apart and merged."""

    classify_numbers: bool = False
    merge_urls: bool = False
    merge_emails: bool = False
    classify_currencies: bool = False
    expand_currency_forms: bool = False
    unmatched: UnmatchedPolicy = UnmatchedPolicy.SYNTHESIZE
    lemmas: LemmaPolicy = LemmaPolicy.ALL

    def __post_init__(self) -> None:
        _require(self.classify_currencies or not self.expand_currency_forms, "currency forms need classified currencies")

    @classmethod
    def conservative(cls) -> TokenizerOptions:
        return cls()

    @classmethod
    def search(cls) -> TokenizerOptions:
        return cls(classify_numbers=True, classify_currencies=True)

    @classmethod
    def entity_aware(cls) -> TokenizerOptions:
        return cls(True, True, True, True, True)


@dataclass(frozen=True)
class AnalysisOptions:
    """Limits and positions of a term stream."""

    max_input_chars: int = 1_000_000
    max_chunk_chars: int = 32_768
    positions: PositionPolicy = PositionPolicy.COMPACT
    client: ClientPolicy = ClientPolicy.ALLOW_ANY
    oversized: OversizedPolicy = OversizedPolicy.FAIL

    def __post_init__(self) -> None:
        _require(self.max_input_chars > 0 and self.max_chunk_chars > 0, "limits must be positive")
        _require(self.max_chunk_chars <= self.max_input_chars, "a chunk can't be larger than the input")


@dataclass(frozen=True)
class AnalyzerOptions:
    """Switches of an external analyzer, rendered in a fixed order."""

    new_line_each_word: bool = False
    copy_input: bool = False
    dictionary_words_only: bool = False
    lemma_only: bool = False
    grammar_info: bool = False
    merge_word_forms: bool = False
    sentence_markers: bool = False
    encoding: Encoding | None = Encoding.UTF_8
    disambiguate: bool = False
    english_grammemes: bool = False
    filter_grammar: str | None = None
    fixlist: str | None = None
    format: OutputFormat = OutputFormat.JSON
    generate_all: bool = False
    weight: bool = False

    def __post_init__(self) -> None:
        _require(self.grammar_info or not self.merge_word_forms, "merged word forms need grammar information")
        _require(self.copy_input or not self.sentence_markers, "sentence markers need copied input")
        _require(self.filter_grammar is None or bool(self.filter_grammar.strip()), "a blank grammar filter")

    def arguments(self) -> list[str]:
        """The command line, always in the same order."""
        # Switch and value options in the analyzer's order.
        switches = [
            ("-n", self.new_line_each_word), ("-c", self.copy_input), ("-w", self.dictionary_words_only), ("-l", self.lemma_only),
            ("-i", self.grammar_info), ("-g", self.merge_word_forms), ("-s", self.sentence_markers), ("-e", self.encoding),
            ("-d", self.disambiguate), ("--eng-gr", self.english_grammemes), ("--filter-gram", self.filter_grammar),
            ("--fixlist", self.fixlist), ("--format", self.format), ("--generate-all", self.generate_all), ("--weight", self.weight),
        ]
        out: list[str] = []
        for name, value in switches:
            if value is True:
                out.append(name)
            elif value:
                out += [name, str(value)]
        return out

    def check_for(self, mode: ExecutionMode) -> None:
        """Whether these options can be used in a mode; the fixlist must be readable by now."""
        _require(self.fixlist is None or os.access(self.fixlist, os.R_OK), "the fixlist can't be read")
        if mode in (ExecutionMode.SESSION, ExecutionMode.POOL):
            _require(self.format == OutputFormat.JSON, "sessions need JSON")
            _require(not self.new_line_each_word, "sessions answer in one line")


@dataclass(frozen=True)
class PoolOptions:
    """The sessions that answer the requests of one running task, and when they are renewed.

    Up to ``max_size`` are asked at once. With several cores to a task more may be set; with one, more
    sessions only compete for it.
    """

    max_size: int = 1
    max_requests_per_worker: int = 2**31 - 1
    max_worker_age_s: float = 0.0
    acquire_timeout_s: float = 2.0
    warmup: int = 0
    min_idle: int = 0
    hook_timeout_s: float = 2.0
    background_replenishment: bool = True

    def __post_init__(self) -> None:
        _require(self.max_size > 0 and self.max_requests_per_worker > 0, "sizes must be positive")
        _require(0 <= self.warmup <= self.max_size and 0 <= self.min_idle <= self.max_size, "warm-up and idle within the size")
        _require(self.max_worker_age_s >= 0 and self.acquire_timeout_s > 0 and self.hook_timeout_s > 0, "times must be positive")


@dataclass(frozen=True)
class Limits:
    """Bounds of one request."""

    timeout_s: float = 3.0
    idle_timeout_s: float = 0.0
    input_chars: int = 1_000_000
    input_bytes: int = 4_000_000
    output_chars: int = 8_000_000
    output_bytes: int = 32_000_000

    def __post_init__(self) -> None:
        _require(min(self.timeout_s, self.input_chars, self.input_bytes, self.output_chars, self.output_bytes) > 0 <= self.idle_timeout_s, "limits must be positive")
