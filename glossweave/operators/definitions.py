"""Drafting concept definitions of glossary terms by a pluggable provider: prompts, checks of what comes back, a cached run."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.caches import definition_key, through_cache

CONFIDENCE = ("low", "medium", "high")
SYSTEM = (
    "A term of one product's user interface follows, with strings that use it, their keys, and how translators rendered it. Say what it "
    "means there. List senses apart where the strings use more than one, with the example keys of each. Write for a translator who has "
    "not seen the product, plainly, and give low confidence where the strings show too little."
)
SCHEMA = {
    "type": "object",
    "properties": {
        "ambiguous": {"type": "boolean"},
        "senses": {
            "type": "array",
            "minItems": 1,
            "items": {
                "type": "object",
                "properties": {"label": {"type": "string"}, "definition": {"type": "string"}, "exampleKeys": {"type": "array", "items": {"type": "string"}}},
                "required": ["label", "definition", "exampleKeys"],
            },
        },
        "translatorNote": {"type": "string"},
        "confidence": {"type": "string", "enum": list(CONFIDENCE)},
    },
    "required": ["ambiguous", "senses", "translatorNote", "confidence"],
}

#: The same as a type of Spark.
RECORD = "struct<ambiguous:boolean,senses:array<struct<label:string,definition:string,exampleKeys:array<string>>>,translatorNote:string,confidence:string>"


class Provider(Protocol):
    name: str
    model: str

    def define(self, system: str, prompt: str) -> dict: ...


class StubProvider:
    """Answers without a model: one sense that repeats the term."""

    name = "stub"

    def __init__(self, model: str = "none"):
        self.model = model

    def define(self, system: str, prompt: str) -> dict:
        term = prompt.split('Term: "', 1)[-1].split('"', 1)[0]
        return {"ambiguous": False, "senses": [{"label": term, "definition": f"The term {term}.", "exampleKeys": []}], "translatorNote": "", "confidence": "low"}


class BadDefinition(ValueError):
    pass


def check_definition(data: object) -> dict:
    """The definition if it has the schema's form; BadDefinition names what is wrong."""
    if not isinstance(data, dict):
        raise BadDefinition("not an object")
    for name, kind in (("ambiguous", bool), ("senses", list), ("translatorNote", str), ("confidence", str)):
        if not isinstance(data.get(name), kind):
            raise BadDefinition(f"{name} is missing or of another type")
    if not data["senses"]:
        raise BadDefinition("senses is empty")
    if data["confidence"] not in CONFIDENCE:
        raise BadDefinition("confidence is none of " + ", ".join(CONFIDENCE))
    for sense in data["senses"]:
        fine = isinstance(sense, dict) and isinstance(sense.get("label"), str) and isinstance(sense.get("definition"), str) and isinstance(sense.get("exampleKeys"), list)
        if not fine or not all(isinstance(k, str) for k in sense["exampleKeys"]):
            raise BadDefinition("a sense lacks label, definition or exampleKeys")
    return data


def quoted(value: str, most: int = 200) -> str:
    return json.dumps(value[:most] + "…" if len(value) > most else value, ensure_ascii=False)


def build_prompt(term: dict, locales: list[dict], source: dict[str, str], domain: str) -> str:
    """The prompt of one term. term: a row of term_results; locales: its locale_stats; source: text by key."""
    used = [p for p in locales if p["occurrences"] > 0][:16]
    shown = {p["locale"]: p["clusters"][:4] for p in used}
    keys = list(dict.fromkeys(k for clusters in shown.values() for c in clusters for k in c["example_keys"][:2]))[:24]

    def rendering(c: dict) -> str:
        form = c["forms"][0]["text"]
        return f"{f'(left in English: {form})' if c['kept_english'] else form} x{c['count']} [{', '.join(c['example_keys'][:2])}]"

    forms = ", ".join(list(term.get("surfaces") or {})[:6]) or "n/a"
    return "\n".join(
        [
            f"Product: {domain}",
            f'Term: "{term["term"]}" (surface forms: {forms})',
            f"Appears in {term['df']} distinct source strings.",
            "",
            "Renderings by language (count of distinct strings, example keys):",
            *[f"- {locale}: {'; '.join(map(rendering, clusters))}" for locale, clusters in shown.items()],
            "",
            "English example strings (key: text):",
            *[f"- {k}: {quoted(source[k])}" for k in keys if source.get(k)],
        ]
    )


def define_terms(prompts: DataFrame, make: Callable[[], Provider], cache: str, workers: int = 4) -> DataFrame:
    """term, definition (JSON) of prompts (term, prompt), each distinct prompt asked once; the first failure ends the run and names
    provider, model and term."""
    probe = make()
    keyed = definition_key(SYSTEM, probe.name, probe.model, prompts)

    def ask(missing: DataFrame) -> DataFrame:
        def run(batches):
            provider = make()
            for batch in batches:
                answers = []
                for r in batch.itertuples():
                    try:
                        answers.append(json.dumps(check_definition(provider.define(SYSTEM, r.prompt))))
                    except Exception as e:
                        raise RuntimeError(f'{provider.name} ({provider.model}) failed on "{r.term}": {e}') from e
                yield batch[["k"]].assign(definition=answers)

        return missing.select("k", "term", "prompt").repartition(workers, F.col("k")).mapInPandas(run, "k string, definition string")

    return keyed.join(through_cache(keyed, cache, ask), "k").select("term", "definition")
