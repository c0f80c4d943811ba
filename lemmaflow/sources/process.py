"""External analyzers as child processes: found, probed, asked one by one or in sessions of JSON lines."""

from __future__ import annotations

import os
import selectors
import shutil
import subprocess
import threading
import time
from collections import deque
from dataclasses import dataclass, replace

from lemmaflow.errors import EngineClosed, EngineNotFound, EngineOutputLimit, EnginePoolExhausted, EngineProcess, EngineProtocol, EngineStartup, EngineTimeout, InvalidOptions
from lemmaflow.options import AnalyzerOptions, Encoding, ExecutionMode, Limits, OutputFormat, PoolOptions

#: Session setting and environment variable that name the executable.
SETTING, VARIABLE = "spark.lemmaflow.executable", "LEMMAFLOW_EXECUTABLE"
# What a probe asks and must find in the answer.
PROBE_TEXT, PROBE_ANSWER = "мама", '"text":"мама"'


@dataclass(frozen=True)
class Stats:
    """Figures of one request; -1 is unknown."""

    elapsed_ms: float
    mode: str
    in_chars: int
    in_bytes: int
    out_chars: int
    out_bytes: int


def resolve_executable(explicit: str | None = None, spark=None, search_path: str | None = None) -> str:
    """The executable: as given, else by session setting, environment, then PATH if ``search_path`` names it."""
    for found in (explicit, spark.conf.get(SETTING, None) if spark else None, os.environ.get(VARIABLE)):
        if found:
            if os.path.isfile(found) and os.access(found, os.X_OK):
                return os.path.abspath(found)
            raise EngineNotFound("the configured executable isn't an executable file")
    found = shutil.which(search_path) if search_path else None
    if not found:
        raise EngineNotFound("no executable is configured")
    return found


def check_input(text: str, limits: Limits, encoding: str, one_line: bool) -> bytes:
    if one_line and ("\n" in text or "\r" in text):
        raise InvalidOptions("a line protocol takes no line breaks")
    if len(text.encode("utf-16-le")) // 2 > limits.input_chars:
        raise InvalidOptions("the input has too many characters")
    try:
        data = text.encode(encoding)
    except UnicodeEncodeError:
        raise InvalidOptions("the input has characters the encoding lacks") from None
    if len(data) > limits.input_bytes:
        raise InvalidOptions("the input has too many bytes")
    return data


def check_output(data: bytes, limits: Limits, encoding: str) -> str:
    if len(data) > limits.output_bytes:
        raise EngineOutputLimit("the answer has too many bytes")
    text = data.decode(encoding, "replace")
    if len(text) > limits.output_chars:
        raise EngineOutputLimit("the answer has too many characters")
    return text


class OneShot:
    """A process for each request."""

    def __init__(self, command: list[str], options: AnalyzerOptions = AnalyzerOptions(), limits: Limits = Limits()):
        options.check_for(ExecutionMode.ONE_SHOT_TEXT)
        self.command, self.options, self.limits = [*command, *options.arguments()], options, limits
        self.encoding = str(options.encoding or Encoding.UTF_8)

    def ask(self, text: str) -> tuple[str, Stats]:
        data, began = check_input(text, self.limits, self.encoding, False), time.monotonic()
        try:
            run = subprocess.run(self.command, input=data, capture_output=True, timeout=self.limits.timeout_s)
        except FileNotFoundError:
            raise EngineStartup("the process can't be started") from None
        except subprocess.TimeoutExpired:
            raise EngineTimeout(f"no answer within {self.limits.timeout_s} s") from None
        except OSError as e:
            raise EngineStartup(f"the process can't be started: {e.strerror}") from None
        if run.returncode:
            raise EngineProcess("the process failed", run.returncode, run.stderr.decode(self.encoding, "replace"))
        out = check_output(run.stdout, self.limits, self.encoding)
        return out, Stats((time.monotonic() - began) * 1000, ExecutionMode.ONE_SHOT_TEXT, len(text), len(data), len(out), len(run.stdout))

    def ask_file(self, source: str, target: str | None = None) -> tuple[str | None, Stats]:
        """The answer for a file, or with ``target`` its writing there; both must not be one file."""
        if not os.path.isfile(source) or not os.access(source, os.R_OK):
            raise InvalidOptions("the input isn't a readable file")
        if target is not None:
            parent = os.path.dirname(os.path.abspath(target))
            if os.path.isdir(target) or not os.path.isdir(parent) or not os.access(parent, os.W_OK):
                raise InvalidOptions("the output can't be written")
            if os.path.realpath(source) == os.path.realpath(target) or (os.path.exists(target) and os.path.samefile(source, target)):
                raise InvalidOptions("input and output are one file")
        with open(source, "rb") as f:
            text = f.read(self.limits.input_bytes + 1).decode(self.encoding, "replace")
        out, stats = self.ask(text)
        stats = Stats(stats.elapsed_ms, ExecutionMode.ONE_SHOT_FILE, *(stats.in_chars, stats.in_bytes, stats.out_chars, stats.out_bytes))
        if target is None:
            return out, stats
        with open(target, "wb") as f:
            f.write(out.encode(self.encoding))
        return None, stats


class Session:
    """A long-lived process: a line in, a line out; after a failure it is of no more use."""

    def __init__(self, command: list[str], options: AnalyzerOptions = AnalyzerOptions(), limits: Limits = Limits(), close_timeout_s: float = 2.0):
        options.check_for(ExecutionMode.SESSION)
        self.close_timeout_s = close_timeout_s
        self.limits, self.encoding = limits, str(options.encoding or Encoding.UTF_8)
        try:
            self.process = subprocess.Popen([*command, *options.arguments()], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, bufsize=0)
        except OSError as e:
            raise EngineStartup(f"the process can't be started: {e.strerror}") from None
        self.born, self.served, self.used = time.monotonic(), 0, time.monotonic()
        self.broken = False
        self._rest = b""
        self._said: deque[bytes] = deque(maxlen=32)
        threading.Thread(target=self._drain, daemon=True).start()

    def _drain(self) -> None:
        for line in iter(lambda: self.process.stderr.read(1024), b""):
            self._said.append(line)

    def _fail(self, error: Exception) -> Exception:
        self.close()
        return error

    def ask(self, text: str) -> tuple[str, Stats]:
        if self.broken:
            raise EngineClosed("the session has ended")
        data, began = check_input(text, self.limits, self.encoding, True), time.monotonic()
        limit = began + self.limits.timeout_s
        try:
            self.process.stdin.write(data + b"\n")
            line = self._line(limit)
        except (BrokenPipeError, ConnectionError):
            raise self._fail(self._ended()) from None
        out = self._checked(line)
        self.served, self.used = self.served + 1, time.monotonic()
        return out, Stats((self.used - began) * 1000, ExecutionMode.SESSION, len(text), len(data), len(out), len(line))

    def _checked(self, line: bytes) -> str:
        try:
            out = check_output(line, self.limits, self.encoding)
        except EngineOutputLimit as e:
            raise self._fail(e) from None
        if not out.lstrip().startswith("["):
            raise self._fail(EngineProtocol("the answer isn't a JSON array"))
        return out

    def _ended(self) -> EngineProcess:
        try:
            code = self.process.wait(0.2)
        except subprocess.TimeoutExpired:
            code = None
        time.sleep(0.02)
        return EngineProcess("the process ended", code, b"".join(self._said).decode(self.encoding, "replace"))

    def _line(self, limit: float) -> bytes:
        out = self.process.stdout
        with selectors.DefaultSelector() as ready:
            ready.register(out, selectors.EVENT_READ)
            while b"\n" not in self._rest:
                if len(self._rest) > self.limits.output_bytes:
                    raise self._fail(EngineOutputLimit("the answer has too many bytes"))
                if not ready.select(max(0.0, limit - time.monotonic())):
                    raise self._fail(EngineTimeout(f"no answer within {self.limits.timeout_s} s"))
                got = os.read(out.fileno(), 1 << 16)
                if not got:
                    raise self._fail(self._ended())
                self._rest += got
        line, _, self._rest = self._rest.partition(b"\n")
        return line.rstrip(b"\r")

    def close(self) -> None:
        self.broken = True
        self.process.kill()
        for pipe in (self.process.stdin, self.process.stdout):
            try:
                pipe.close()
            except OSError:
                pass
        try:
            self.process.wait(self.close_timeout_s)
        except subprocess.TimeoutExpired:
            pass  # it was told to end; nobody waits for it any longer


class Pool:
    """Sessions for the requests of one task, lent to one request at a time.

    ``warmup`` sessions start at once; after each request enough are started to have ``min_idle`` free, by
    a thread of their own with ``background_replenishment``, else before the request's answer is given.
    A session that is spent, too old, idle too long or broken is replaced. A request that finds all
    ``max_size`` sessions lent waits ``acquire_timeout_s`` at most.
    """

    def __init__(self, command: list[str], options: AnalyzerOptions, limits: Limits, pool: PoolOptions):
        self._new = lambda: Session(command, options, limits, pool.hook_timeout_s)
        self.pool, self.limits = pool, limits
        self._free: deque[Session] = deque()
        self._changed = threading.Condition()
        self._lent = self._starting = self.started = 0
        self._closed = False
        self._fill(max(pool.warmup, pool.min_idle))

    def _fill(self, least: int) -> None:
        """Starts sessions until ``least`` are free or the pool is full; others may be lent meanwhile."""
        while True:
            with self._changed:
                if self._closed or len(self._free) >= least or self._lent + len(self._free) + self._starting >= self.pool.max_size:
                    return
                self._starting += 1
            s = None
            try:
                s = self._new()
            finally:
                with self._changed:
                    self._starting -= 1
                    if s is not None:
                        self.started += 1
                        self._free.append(s)
                    if self._closed:
                        self._end_free()
                    self._changed.notify()

    def _replenish(self) -> None:
        try:
            self._fill(self.pool.min_idle)
        except EngineStartup:
            pass  # the next request that needs a session meets the same failure

    def _end_free(self) -> None:
        while self._free:
            self._free.popleft().close()

    def _usable(self, s: Session) -> bool:
        now = time.monotonic()
        old, idle = self.pool.max_worker_age_s, self.limits.idle_timeout_s
        return not (s.broken or s.served >= self.pool.max_requests_per_worker or 0 < old < now - s.born or 0 < idle < now - s.used)

    def _acquire(self) -> Session:
        until = time.monotonic() + self.pool.acquire_timeout_s
        with self._changed:
            while True:
                if self._closed:
                    raise EngineClosed("the pool has ended")
                while self._free:
                    s = self._free.popleft()
                    if self._usable(s):
                        self._lent += 1
                        return s
                    s.close()
                if self._lent + self._starting < self.pool.max_size:
                    self._lent += 1
                    break
                if not self._changed.wait(max(0.0, until - time.monotonic())) and time.monotonic() >= until:
                    raise EnginePoolExhausted(f"no free session within {self.pool.acquire_timeout_s} s")
        try:
            s = self._new()
        except BaseException:
            self._give_back(None)
            raise
        with self._changed:
            self.started += 1
        return s

    def _give_back(self, s: Session | None) -> None:
        with self._changed:
            self._lent -= 1
            if s is not None:
                if self._closed or not self._usable(s):
                    s.close()
                else:
                    self._free.append(s)
            self._changed.notify()
        if s is not None and self.pool.min_idle:
            if self.pool.background_replenishment:
                threading.Thread(target=self._replenish, daemon=True).start()
            else:
                self._replenish()

    def ask(self, text: str) -> tuple[str, Stats]:
        s = self._acquire()
        try:
            out, stats = s.ask(text)
        finally:
            self._give_back(s)
        return out, replace(stats, mode=str(ExecutionMode.POOL))

    def close(self) -> None:
        """Ends the free sessions now and lent ones when they come back."""
        with self._changed:
            self._closed = True
            self._end_free()
            self._changed.notify_all()


def probe(executable: str, timeout_s: float = 5.0) -> tuple[str, Stats]:
    """Asks for one word; the answer must be an array that holds it."""
    out, stats = OneShot([executable], AnalyzerOptions(format=OutputFormat.JSON), Limits(timeout_s=timeout_s)).ask(PROBE_TEXT)
    if not (out.strip().startswith("[") and out.strip().endswith("]") and PROBE_ANSWER in out.replace(" ", "")):
        raise EngineProtocol("the probe's answer isn't what it should be")
    return out, stats
