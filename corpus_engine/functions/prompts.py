"""Prompt templates, request/response bodies and answer cleanup as Column expressions.

Templates are filled with ``concat`` of literal parts (never regex replacement: contexts
may hold '$' or '\\')."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_engine.functions.text import strip_ws

# Prompt templates of the question-answering application, with their
# placeholders, exactly as the application fills them.
STANDARD_TEMPLATE = """<|begin_of_text|><|start_header_id|>system<|end_header_id|>
You are an expert AI assistant specializing in haptics domain, tasked with providing accurate, concise responses.
Explain concepts using the context like i am a 15 year old.
Offer clear, direct explanations of key haptic concepts.
You are instructed to use the context given below to answer the user question.
If the context is not of good quality then provide a general answer to the user question.
The context is  you need to derive your answer from = 
{context}
The question is =
<|eot_id|><|start_header_id|>user<|end_header_id|>
{query}<|eot_id|><|start_header_id|>assistant<|end_header_id|>Your Answer = """

EXPANSION_TEMPLATE = """<|begin_of_text|><|start_header_id|>system<|end_header_id|>
        You are a haptics domain researcher instructed to answer the user question in max 3 lines in the tone of a research paper. 
        Your task is to write a small answer to the given question with respect to Haptics. 
        It must be concise 2-line answer that captures the core information need. 
        Focus on the key technical concepts and terminology.
        <|eot_id|><|start_header_id|>user<|end_header_id|>
        {query}<|eot_id|><|start_header_id|>assistant<|end_header_id|>"""

EXPERT_QUESTION_TEMPLATE = """You are a haptics domain expert. Please answer the following question:
        
Question: {query}

Please provide a clear and concise response focusing on haptics-related information."""

CONTEXT_QUESTION_TEMPLATE = "Context: {context}\n\nQuestion: {query}"
CONTEXT_QUESTION_ANSWER_TEMPLATE = ("Context: {context}\n\nQuestion: {query}\n\n"
                                    "Provide a clear and concise answer based on the context provided.")
INSTRUCT_TEMPLATE = "<s>[INST] Context: {context} Question: {query} [/INST]"
CONTEXT_SYSTEM_PROMPT = ("You are an expert in haptics technology. Use the provided context to "
                         "answer questions accurately and concisely.")

# model -> (template, uses_context, error prefix shown when the call failed)
MODEL_PROMPTS = {
    "rag": (STANDARD_TEMPLATE, True, "An error occurred: "),
    "enhanced": (STANDARD_TEMPLATE, True, "An error occurred: "),
    "claude_v1": (EXPERT_QUESTION_TEMPLATE, False, "An error occurred while calling Claude API: "),
    "gpt_v1": ("{query}", False, "An error occurred while calling GPT API: "),
    "gpt": (CONTEXT_QUESTION_TEMPLATE, True, "An error occurred: "),
    "claude": (CONTEXT_QUESTION_ANSWER_TEMPLATE, True, "An error occurred: "),
    "mistral": (INSTRUCT_TEMPLATE, True, "An error occurred: "),
}

# Answer cleanup.
QUESTION_SPLIT = "The question is ="
ANSWER_MARKERS = (
    "<|begin_of_text|>",
    "<|start_header_id|>",
    "<|end_header_id|>",
    "<|eot_id|>",
    "system",
    "user",
    "assistant",
    "Your Answer =",
)
DROP_LINE_WORDS = ("date:", "cutting", "today")
NO_CONTENT = "No content generated."
UNCAUGHT_PREFIX = "Error: "


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def template_parts(template: str):
    """Split a template into literal parts and placeholder names, in order."""
    parts, rest = [], template
    while "{" in rest:
        i = rest.index("{")
        j = rest.index("}", i)
        parts.append(("lit", rest[:i]))
        parts.append(("var", rest[i + 1:j]))
        rest = rest[j + 1:]
    parts.append(("lit", rest))
    return parts


def fill(template: str, **values) -> Column:
    """Literal substitution of ``{name}`` placeholders with columns (nulls become '')."""
    cols = []
    for kind, v in template_parts(template):
        if kind == "lit":
            if v:
                cols.append(F.lit(v))
        else:
            cols.append(F.coalesce(_col(values[v]), F.lit("")))
    return F.concat(*cols) if cols else F.lit("")


def clean_answer(c) -> Column:
    """Keep the text between the first and second 'The question is =' (when present),
    delete the markers anywhere (case-sensitive), drop lines mentioning dates, strip."""
    src = _col(c)
    out = F.when(F.instr(src, QUESTION_SPLIT) > 0,
                 F.split_part(src, F.lit(QUESTION_SPLIT), F.lit(2))).otherwise(src)
    for marker in ANSWER_MARKERS:
        out = F.replace(out, F.lit(marker), F.lit(""))

    def keep(line):
        low = F.lower(line)
        hit = F.lit(False)
        for w in DROP_LINE_WORDS:
            hit = hit | (F.instr(low, w) > 0)
        return ~hit

    out = F.array_join(F.filter(F.split(out, "\n", -1), keep), "\n")
    return strip_ws(out)


def claude_request_body(prompt) -> Column:
    """Messages-style JSON body with one user turn holding one text part."""
    return F.to_json(F.struct(
        F.lit("bedrock-2023-05-31").alias("anthropic_version"),
        F.lit(1000).alias("max_tokens"),
        F.array(F.struct(
            F.lit("user").alias("role"),
            F.array(F.struct(F.lit("text").alias("type"), _col(prompt).alias("text"))).alias("content"),
        )).alias("messages"),
    ))


def mistral_request_body(prompt) -> Column:
    """Completion-style JSON body with sampling parameters."""
    return F.to_json(F.struct(
        _col(prompt).alias("prompt"),
        F.lit(200).alias("max_tokens"),
        F.lit(0.5).alias("temperature"),
        F.lit(0.9).alias("top_p"),
        F.lit(50).alias("top_k"),
    ))


# Sampling parameters of the chat and messages calls.
GPT_SAMPLING = {"model": "gpt-4", "temperature": 0.7, "max_tokens": 500}
GPT_V1_SAMPLING = {"model": "gpt-4o"}
CLAUDE_V1_SAMPLING = {"model": "claude-3-sonnet-20240229", "max_tokens": 1024, "temperature": 0.7}


def chat_request_body(prompt, system: str | None, sampling: dict) -> Column:
    """Chat-style JSON body: an optional system turn, one user turn and sampling parameters."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    turns = ([turn("system", F.lit(system))] if system else []) + [turn("user", _col(prompt))]
    return F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sampling.items()], F.array(*turns).alias("messages")))


def generation_request_body(prompt) -> Column:
    """Body for a local text-generation model: the rendered prompt alone."""
    return F.to_json(F.struct(_col(prompt).alias("inputs")))


#: model -> builder of its request body.
REQUEST_BODIES = {
    "rag": generation_request_body,
    "enhanced": generation_request_body,
    "gpt": lambda p: chat_request_body(p, CONTEXT_SYSTEM_PROMPT, GPT_SAMPLING),
    "gpt_v1": lambda p: chat_request_body(p, None, GPT_V1_SAMPLING),
    "claude": claude_request_body,
    "claude_v1": lambda p: chat_request_body(p, None, CLAUDE_V1_SAMPLING),
    "mistral": mistral_request_body,
}


# Where each response format keeps the generated text.
RESPONSE_PATHS = {
    "messages": "$.content[0].text",
    "completion": "$.outputs[0].text",
    "chat": "$.choices[0].message.content",
}


def response_text(body, fmt: str) -> Column:
    text = F.get_json_object(_col(body), RESPONSE_PATHS[fmt])
    if fmt == "chat":
        # A chat response without choices reads as a fixed message.
        return F.coalesce(text, F.lit(NO_CONTENT))
    return text
