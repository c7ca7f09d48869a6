"""Template prompts (G1-G5), the keyword category heuristic table (V12) and
the responder hook (G6).

Prompt synthesis is a narrow projection over an id table: every random
choice is ``md5(seed:slot:id)`` modulo the list size, so a prompt depends
only on its id.  The catalogue is a fixed, small set of literals inlined into
the expressions (no join, no broadcast).
"""

from __future__ import annotations

import itertools
import queue
import threading
import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Category names, placeholder slots with the list they draw
# from and their prefix / suffix wrappers, and the keyword heuristic.
# ---------------------------------------------------------------------------
CATEGORIES = [
    "general_knowledge", "reasoning", "creative_writing", "problem_solving", "explanation",
    "analysis", "comparison", "instruction_following", "conversation", "factual_questions",
    "location_based",
]

# placeholder -> (list, prefix, suffix)
SLOTS = {
    "topic": ("topics", "", ""), "activity": ("activities", "", ""), "problem": ("problems", "", ""),
    "concept": ("topics", "", ""), "process": ("activities", "", ""), "subject": ("topics", "", ""),
    "task": ("activities", "", ""), "goal": ("topics", "improve ", ""), "challenge": ("problems", "", ""),
    "skill": ("topics", "", ""), "event": ("topics", "the development of ", ""), "domain": ("topics", "", ""),
    "data_type": ("data_types", "", ""), "phenomenon": ("topics", "", ""), "item1": ("topics", "", ""),
    "item2": ("topics", "", ""), "concept1": ("topics", "", ""), "concept2": ("topics", "", ""),
    "option1": ("topics", "", ""), "option2": ("topics", "", ""), "context1": ("contexts", "", ""),
    "context2": ("contexts", "", ""), "approach1": ("approaches", "", ""), "approach2": ("approaches", "", ""),
    "controversial_statement": ("claims", "", ""), "complex_topic": ("topics", "", ""),
    "ongoing_topic": ("topics", "", ""), "person": ("persons", "", ""), "field": ("topics", "", ""),
    "item": ("topics", "", ""), "statement": ("topics", "", " is overrated"), "premise": ("premises", "", ""),
    "situation": ("situations", "", ""), "action": ("topics", "implement ", ""),
}

CATEGORY_KEYWORDS = {
    "general_knowledge": ["what is", "explain", "facts about", "how does"],
    "reasoning": ["conclude", "logical", "why might", "factors"],
    "creative_writing": ["write", "story", "dialogue", "poetic"],
    "problem_solving": ["solve", "steps", "approach", "improve"],
    "explanation": ["explain", "break down", "teach", "principles"],
    "analysis": ["pros and cons", "analyze", "patterns", "causes"],
    "comparison": ["compare", "contrast", "similarities", "differences"],
    "instruction_following": ["list", "guide", "instructions", "how do you"],
    "conversation": ["say to someone", "respond", "advice", "questions"],
    "factual_questions": ["facts about", "when did", "who was", "where can"],
}

# ---------------------------------------------------------------------------
# The catalogue: templates per category and value lists per slot, written for
# this library (only the categories and slots above are fixed).
# ---------------------------------------------------------------------------
TEMPLATES = {
    "general_knowledge": ["What is {topic}, in plain terms?", "Tell a visitor the main points of {subject}.",
                          "How does {concept} show up on an ordinary day?"],
    "reasoning": ["Suppose that {premise}. What can be said to conclude?", "Why might {phenomenon} surprise a newcomer?",
                  "Name the factors that weigh most in {domain}."],
    "creative_writing": ["Invent a tale in which {topic} plays a part, and write it down.",
                         "Put {person} and a child into one dialogue.", "Turn {situation} into four poetic lines."],
    "problem_solving": ["A town wants to solve {problem}. Where should it begin?", "Set out the steps to {goal}.",
                        "Which approach to {challenge} costs least?"],
    "explanation": ["Explain {complex_topic} with one everyday picture.", "Break down {field} for an evening class.",
                    "Teach a friend the knack of {process}."],
    "analysis": ["Analyze what {item} gives and what it takes.", "Look for patterns in {data_type}.",
                 "Trace the causes behind {event}."],
    "comparison": ["Compare {item1} with {item2} in two sentences.", "Contrast {concept1} and {concept2}.",
                   "Set {topic} as seen in {context1} beside {topic} as seen in {context2}.",
                   "Someone must choose {option1} or {option2}: which, and why?",
                   "Where does {approach1} beat {approach2}?"],
    "instruction_following": ["List what to prepare before you {task}.", "Draw up a one-page guide to {activity}.",
                              "Give instructions that {goal}."],
    "conversation": ["A neighbour insists that {controversial_statement}. How would you respond?",
                     "Your cousin says {statement}. Keep the talk friendly.",
                     "Offer advice to someone new to {ongoing_topic}."],
    "factual_questions": ["State three facts about {topic} that can be checked.", "When did {event} first make news?",
                          "Who was known for {field} a century ago?"],
    "location_based": ["Where can a beginner meet others interested in {topic}?", "Name a region with a name for {skill}.",
                       "Which town was early to {action}?"],
}

LISTS = {
    "topics": ["tidal power", "graph databases", "medieval trade routes", "coral reefs", "street lighting",
               "vaccination campaigns", "counterpoint", "orbital mechanics", "prime numbers", "fermentation",
               "cloud formation", "sign languages", "bridge building", "auction theory", "plant breeding", "stoicism"],
    "activities": ["knitting a scarf", "repairing a bicycle", "keeping bees", "drafting a contract",
                   "tuning a piano", "pruning fruit trees", "sorting an archive", "brewing coffee"],
    "problems": ["leaking pipes", "missed deadlines", "noisy nights", "soil erosion", "password reuse",
                 "empty shelves"],
    "data_types": ["sensor readings", "library loans", "ferry timetables"],
    "contexts": ["a mountain village", "a shipyard", "a primary school", "a newsroom", "an orchard", "a courtroom"],
    "approaches": ["trial and error", "a written checklist", "working in pairs", "a scale model"],
    "claims": ["libraries should open all night", "bicycles belong on every train", "handwriting no longer matters",
               "zoos do more good than harm"],
    "persons": ["a lighthouse keeper", "a night nurse", "a land surveyor", "a market trader"],
    "premises": ["the river runs dry a week earlier each year", "every shop closes at noon",
                 "two clocks in one house disagree"],
    "situations": ["a power cut", "a harvest festival", "a delayed ferry", "a first snowfall"],
}


def _h(seed: int, name: str, key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), key.cast("string"))), 1, 8),
                  16, 10).cast("bigint")


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values) + 1).cast("int"))


def synthesize_prompts(ids: DataFrame, key: str = "id", seed: int = 42, batch_size: int = 100) -> DataFrame:
    """One prompt per id: uniform category, uniform template of it,
    every placeholder filled from its list (a placeholder repeated in a
    template gets one value); ``batch_id = id div batch_size``."""
    k = F.col(key)
    cat_i = _h(seed, "category", k) % len(CATEGORIES)
    per_cat = F.array(*[F.array(*[F.lit(t) for t in TEMPLATES[c]]) for c in CATEGORIES])
    sizes = F.array(*[F.lit(len(TEMPLATES[c])) for c in CATEGORIES])
    chosen = F.element_at(per_cat, (cat_i + 1).cast("int"))
    tpl_i = _h(seed, "template", k) % F.element_at(sizes, (cat_i + 1).cast("int"))
    prompt = F.element_at(chosen, (tpl_i + 1).cast("int"))
    for slot, (lst, pre, suf) in SLOTS.items():
        value = F.concat(F.lit(pre), _pick(LISTS[lst], _h(seed, slot, k)), F.lit(suf))
        prompt = F.replace(prompt, F.lit("{" + slot + "}"), value)
    return ids.select(k.alias(key), F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]),
                                                 (cat_i + 1).cast("int")).alias("category"),
                      prompt.alias("prompt"), F.floor(k / batch_size).cast("bigint").alias("batch_id"))


def catalogue_values(spark) -> DataFrame:
    """``slot, value`` for every list entry (input of ``stats.catalogue_sizes``)."""
    rows = [("categories", c) for c in CATEGORIES]
    rows += [("templates", t) for c in CATEGORIES for t in TEMPLATES[c]]
    rows += [(name, v) for name, vals in LISTS.items() for v in vals]
    return spark.createDataFrame(rows, "slot string, value string")


# ---------------------------------------------------------------------------
# Responder hook
# ---------------------------------------------------------------------------
RESULT_SCHEMA = T.StructType([
    T.StructField("prompt", T.StringType()), T.StructField("response", T.StringType()),
    T.StructField("timestamp", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("success", T.BooleanType()), T.StructField("request_index", T.LongType()),
    T.StructField("error", T.StringType()), T.StructField("error_type", T.StringType()),
])


def answers(responder: Callable[[str], str], prompts: list[str], concurrency: int, timeout: float) -> list[tuple]:
    """``(answer, None)`` or ``(None, error)`` per prompt.  A call is timed from
    its own start; one that takes too long gives its place to the next prompt
    and is left behind in its daemon thread."""
    done: queue.Queue = queue.Queue()

    def call(k: int, prompt: str) -> None:
        try:
            done.put((k, (responder(prompt), None)))
        except Exception as e:  # noqa: BLE001 - every failure becomes a row
            done.put((k, (None, e)))

    out: list = [None] * len(prompts)
    running: dict[int, float] = {}  # call -> when its time is up
    todo = iter(enumerate(prompts))
    while True:
        for k, prompt in itertools.islice(todo, concurrency - len(running)):
            running[k] = time.monotonic() + timeout
            threading.Thread(target=call, args=(k, prompt), daemon=True).start()
        if not running:
            return out
        try:
            k, result = done.get(timeout=max(0.0, min(running.values()) - time.monotonic()))
            if running.pop(k, None) is not None:  # else it was given up before
                out[k] = result
        except queue.Empty:
            for k in [k for k, end in running.items() if end <= time.monotonic()]:
                del running[k]
                out[k] = None, TimeoutError(f"no answer within {timeout:g} s")


def enrich(prompts: DataFrame, responder: Callable[[str], str], key: str = "id", text: str = "prompt",
           parallelism: int | None = None, concurrency: int = 8, timeout: float = 30.0,
           model: str = "responder", carry: list[str] | None = None) -> DataFrame:
    """Call ``responder(prompt)`` for every prompt (the one place where
    Python runs per row: it is an external call).  ``parallelism`` bounds the
    number of tasks, ``concurrency`` the calls in flight per task; a call
    that raises or takes more than ``timeout`` seconds becomes a failed row
    with the error text and exception class.  ``request_index`` is the key, so
    no order has to be restored.  ``carry`` names columns that go along."""
    carry = list(carry or [])
    schema = T.StructType([*RESULT_SCHEMA.fields, *(prompts.schema[c] for c in carry)])
    df = prompts.select(F.col(key).cast("string").alias("_k"), F.col(text).alias("_p"), *[F.col(c).cast("string") for c in carry])
    if parallelism:
        df = df.repartition(parallelism)

    def run(batches):
        import pandas as pd
        for pdf in batches:
            out = []
            got = answers(responder, list(pdf["_p"]), concurrency, timeout)
            for k, p, (r, e), *rest in zip(pdf["_k"], pdf["_p"], got, *(pdf[c] for c in carry)):
                kind = type(e).__name__ if e else None
                out.append((p, r, datetime.now().isoformat(), model, e is None, k, (str(e) or kind) if e else None, kind, *rest))
            yield pd.DataFrame(out, columns=[f.name for f in texts.fields], dtype=object)

    # keys and carried columns travel as text: a null among numbers would make them floats
    texts = T.StructType([T.StructField(f.name, f.dataType if f.name in ("success",) else T.StringType()) for f in schema.fields])
    return df.mapInPandas(run, texts).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def stub_responder(prompt: str) -> str:
    """Deterministic stand-in for a remote model (tests and examples): fails
    with a timeout or another error for some prompts, answers the rest."""
    import hashlib
    d = hashlib.md5(prompt.encode()).hexdigest()
    if d[0] == "0":
        raise TimeoutError("Request timed out")
    if d[0] == "1":
        raise ConnectionError("Connection reset by peer")
    return f"A short answer about: {prompt}"
