"""Fetching and unpacking an analyzer's archive on the driver; no query needs it."""

from __future__ import annotations

import fcntl
import hashlib
import os
import shutil
import tarfile
import time
import urllib.request
import zipfile
from contextlib import contextmanager

from lemmaflow.errors import InvalidOptions


@contextmanager
def _locked(target: str):
    """One process at a time works on ``target``; others wait."""
    with open(f"{target}.lock", "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        yield


def _cached(target: str, sha256: str | None) -> bool:
    """Whether ``target`` is whole: it has the digest asked for, or else the one noted beside it when it was fetched."""
    note = f"{target}.sha256"
    if not os.path.exists(target):
        return False
    if sha256 is None and os.path.exists(note):
        with open(note) as f:
            sha256 = f.read().split()[0]
    return sha256 is not None and digest(target) == sha256.lower()


def fetch(url: str, target: str, sha256: str | None = None, license_accepted: bool = False, max_bytes: int = 200 << 20, attempts: int = 3, delay_s: float = 0.1) -> str:
    """The archive at ``target``, downloaded unless it is there already with the right digest.

    Its digest is noted in a file beside it, and a lock keeps processes from fetching it twice.
    """
    if not license_accepted:
        raise InvalidOptions("the licence must be accepted")
    if url.startswith(("http:", "https:")) and not sha256:
        raise InvalidOptions("a download needs its digest")
    with _locked(target):
        if not _cached(target, sha256):
            _download(url, target, sha256, max_bytes, attempts, delay_s)
    return target


def _download(url: str, target: str, sha256: str | None, max_bytes: int, attempts: int, delay_s: float) -> None:
    part, last = f"{target}.part{os.getpid()}", None
    for n in range(attempts):
        try:
            with urllib.request.urlopen(url) as source, open(part, "wb") as out:
                size = 0
                while block := source.read(1 << 20):
                    size += len(block)
                    if size > max_bytes:
                        raise InvalidOptions("the archive is too large")
                    out.write(block)
            found = digest(part)
            if sha256 and found != sha256.lower():
                raise InvalidOptions("the archive has another digest")
            os.replace(part, target)
            with open(f"{target}.sha256", "w") as f:
                f.write(f"{found}  {os.path.basename(target)}\n")
            return
        except OSError as e:
            last = e
            time.sleep(delay_s if n + 1 < attempts else 0)
        finally:
            if os.path.exists(part):
                os.remove(part)
    raise InvalidOptions(f"the archive can't be fetched: {type(last).__name__}")


def digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def unpack(archive: str, directory: str, executable: str) -> str:
    """Unpacks a zip or tar.gz and gives the path of its executable."""
    shutil.rmtree(directory, ignore_errors=True)
    os.makedirs(directory)
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            z.extractall(directory)
    elif tarfile.is_tarfile(archive):
        with tarfile.open(archive) as t:
            t.extractall(directory, filter="data")
    else:
        raise InvalidOptions("neither zip nor tar")
    for folder, _, names in os.walk(directory):
        if executable in names:
            path = os.path.join(folder, executable)
            os.chmod(path, 0o755)
            return path
    raise InvalidOptions("the archive lacks the executable")
