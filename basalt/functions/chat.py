"""Chat rendering: conversations (one row a turn) to prompt strings, and the two common JSON layouts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SYSTEM = "You are a helpful assistant."


@dataclass(frozen=True)
class Template:
    """message and prompt hold {role} and {content}; roles renames roles; by_role overrides message for a role."""

    message: str
    prompt: str = ""
    bos: str = ""
    system: str | None = None
    roles: dict[str, str] = field(default_factory=dict)
    by_role: dict[str, str] = field(default_factory=dict)


# The markers of the known templates, and the names each goes by.
TEMPLATES = {
    "llama3": Template("<|start_header_id|>{role}<|end_header_id|>\n\n{content}<|eot_id|>", "<|start_header_id|>assistant<|end_header_id|>\n\n", "<|begin_of_text|>"),
    "chatml": Template("<|im_start|>{role}\n{content}<|im_end|>\n", "<|im_start|>assistant\n", "", DEFAULT_SYSTEM),
    "mistral": Template("{content}</s>", "", "<s>", by_role={"user": "[INST] {content} [/INST]", "system": "[INST] {content} [/INST]"}),
    "zephyr": Template("<|{role}|>\n{content}</s>\n", "<|assistant|>\n"),
    "phi3": Template("<|{role}|>\n{content}<|end|>\n", "<|assistant|>\n", "<s>"),
    "gemma": Template("<start_of_turn>{role}\n{content}<end_of_turn>\n", "<start_of_turn>model\n", "<bos>", roles={"assistant": "model", "system": "user"}),
    "generic": Template("{role}: {content}\n", "assistant: "),
}
ALIASES = {
    "llama3": "llama3 llama-3 llama3.1 llama3.2",
    "chatml": "chatml qwen qwen2 qwen2.5",
    "mistral": "mistral mistral-v0.1 mistral-v0.3",
    "zephyr": "zephyr zephyr-beta",
    "phi3": "phi3 phi-3 phi3.5",
    "gemma": "gemma gemma-2 gemma2",
}


def template(name: str) -> Template | None:
    return next((TEMPLATES[k] for k, names in ALIASES.items() if name.lower() in names.split()), None)


def _fill(pattern: str, role: Column, content: Column) -> Column:
    parts: list[Column] = []
    for piece in pattern.replace("{role}", "\0R\0").replace("{content}", "\0C\0").split("\0"):
        parts.append(role if piece == "R" else content if piece == "C" else F.lit(piece))
    return F.concat(*parts)


def message(t: Template, role: Column, content: Column) -> Column:
    """One rendered message."""
    named = role
    for own, other in t.roles.items():
        named = F.when(role == own, F.lit(other)).otherwise(named)
    out = _fill(t.message, named, content)
    for own, pattern in t.by_role.items():
        out = F.when(role == own, _fill(pattern, named, content)).otherwise(out)
    return out


def render(turns: DataFrame, t: Template, prompt: bool = False, conversation: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """(conversation, prompt): one string a conversation, its turns in order. Turns of one conversation meet in a task."""
    one = turns.select(F.col(conversation), F.col(turn).alias("_t"), (F.col(role) == "system").alias("_s"), message(t, F.col(role), F.coalesce(F.col(content), F.lit(""))).alias("_m"))
    got = one.groupBy(conversation).agg(F.max("_s").alias("_s"), F.array_sort(F.collect_list(F.struct("_t", "_m"))).alias("_l"))
    body = F.array_join(F.transform("_l", lambda x: x["_m"]), "")
    system = F.when(~F.coalesce(F.col("_s"), F.lit(False)), message(t, F.lit("system"), F.lit(t.system))).otherwise("") if t.system else F.lit("")
    return got.select(conversation, F.concat(F.lit(t.bos), system, body, F.lit(t.prompt if prompt else "")).alias("prompt"))


SHAREGPT, OPENAI = "struct<conversations:array<struct<`from`:string,value:string>>>", "struct<messages:array<struct<role:string,content:string>>>"


def sharegpt_to_openai(json: Column) -> Column:
    """{"conversations": [{from, value}]} as {"messages": [{role, content}]}; roles keep their names."""
    return F.to_json(F.struct(F.transform(F.from_json(json, SHAREGPT)["conversations"], lambda m: F.struct(m["from"].alias("role"), m["value"].alias("content"))).alias("messages")))


def openai_to_sharegpt(json: Column) -> Column:
    return F.to_json(F.struct(F.transform(F.from_json(json, OPENAI)["messages"], lambda m: F.struct(m["role"].alias("from"), m["content"].alias("value"))).alias("conversations")))
