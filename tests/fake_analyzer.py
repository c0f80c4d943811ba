"""A stand-in for an analyzer: answers a line with one token; modes for everything that can go wrong."""

import json
import os
import sys
import time

mode = sys.argv[1] if len(sys.argv) > 1 and not sys.argv[1].startswith("-") else "echo"
if mode == "fail":
    sys.stderr.write("bad things")
    sys.exit(3)
if mode == "sleep":
    time.sleep(30)
if mode == "whole":
    sys.stdout.write(json.dumps([{"text": sys.stdin.read().strip()}], ensure_ascii=False, separators=(",", ":")))
    sys.exit(0)
served = 0
for line in sys.stdin:
    text = line.rstrip("\n")
    if mode == "exit" or text == "die":
        sys.exit(7)
    if mode == "slow":
        time.sleep(1)
    if mode == "noisy":
        sys.stderr.write("x" * 100_000)
        sys.stderr.flush()
    answer = "no json" if mode == "text" else "[" + "1" * 10_000 + "]" if mode == "large" else json.dumps([{"text": w, "analysis": [{"lex": w.lower()}]} for w in text.split()] or [{"text": text}], ensure_ascii=False)
    if mode == "pid":
        answer = json.dumps([{"text": str(os.getpid())}])
    sys.stdout.write(answer + "\n")
    sys.stdout.flush()
