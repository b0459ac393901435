"""Text columns: cleaning, cutting, templates and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import uniform


def split_on(text: Column, separator: str) -> Column:
    """Pieces between occurrences of a literal separator."""
    return F.split(text, "\\Q" + separator + "\\E", -1)


def words(text: Column) -> Column:
    """Split at single blanks, as the word-count rules do (empty pieces count)."""
    return split_on(text, " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def before(text: Column, marker: str) -> Column:
    return F.substring_index(text, marker, 1)


def after(text: Column, marker: str) -> Column:
    """What follows the first marker; null without it."""
    at = F.locate(marker, text)
    return F.when(at > 0, F.substring(text, at + len(marker), F.length(text)))


def pair_columns(kind: str) -> tuple[Column, Column]:
    """Instruction and response columns of one of the known layouts."""
    if kind == "instruction":
        return instruction_with_input(F.col("instruction"), F.col("input")), F.col("output")
    if kind == "conversation":
        return F.col("conversation")[0]["content"], F.col("conversation")[1]["content"]
    names = {
        "dialogue": ("patient", "doctor"),
        "problem": ("problem", "solution"),
        "question": ("question", "answer"),
        "query": ("query", "response"),
        "prompt": ("prompt", "completion"),
        "pair": ("instruction", "response"),
    }
    return tuple(F.col(c) for c in names[kind])


def unify_pairs(df: DataFrame, kind: str) -> DataFrame:
    """(instruction, response); other columns are dropped."""
    a, b = pair_columns(kind)
    return df.select(a.alias("instruction"), b.alias("response"))


def instruction_with_input(instruction: Column, extra: Column) -> Column:
    return F.when(F.coalesce(extra, F.lit("")) == "", instruction).otherwise(F.concat_ws(" ", instruction, extra))


def clean_generated(text: Column, marker: str = "Orig") -> Column:
    return F.regexp_replace(strip(before(text, marker)), r"\n+", " ")


def flatten_whitespace(text: Column, quotes: bool = False) -> Column:
    flat = F.translate(text, "\n\t", "  ")
    return F.translate(flat, "\"'", "") if quotes else flat


def word_count_at_least(text: Column, n: int) -> Column:
    return F.size(words(strip(text))) >= n


def _nonempty(text: Column, min_words: int) -> Column:
    return F.when(word_count_at_least(text, min_words) & (strip(text) != ""), strip(text))


def cut_output(text: Column, rule: str = "plain", min_words: int = 1) -> Column:
    """Cut at the first quote, else newline, else keep up to the last period; null is a reject.

    ``rule="question"`` keeps the text up to its first question mark instead.
    """
    if rule == "question":
        cut = F.when(F.locate("?", text) > 0, F.concat(before(text, "?"), F.lit("?")))
    else:
        cut = (
            F.when(F.locate('"', text) > 0, before(text, '"'))
            .when(F.locate("\n", text) > 0, before(text, "\n"))
            .when(F.locate(".", text) > 0, F.regexp_extract(text, r"(?s)^(.*\.)", 1))
        )
    return _nonempty(cut, min_words)


def cut_question(text: Column, answer: Column, min_words: int = 1) -> Column:
    cut = _nonempty(F.when(F.locate("?", text) > 0, F.concat(before(text, "?"), F.lit("?"))), min_words)
    return F.when(~F.contains(F.lower(cut), F.lower(answer)), cut)


def cut_answer(text: Column) -> Column:
    cut = F.when(F.locate('"', text) > 0, before(text, '"')).when(F.locate(".", text) > 0, before(text, "."))
    return F.when(strip(cut) != "", strip(cut))


def extract_example(text: Column) -> dict[str, Column]:
    """Instruction and output of the first example block; null where a marker is missing or doubled."""
    ins = before(after(text, "##instruction:"), "##output:")
    out = before(after(text, "##output:"), "###example:")
    good = (F.locate("##output:", text) > F.locate("##instruction:", text)) & ~out.contains("##")
    return {"instruction": F.when(good, strip(ins)), "output": F.when(good, strip(out))}


def strip_markers(text: Column) -> Column:
    return strip(before(F.replace(text, F.lit("<|im_end|>"), F.lit("")), "##"))


#: Style -> (system line, prefix and suffix of user and assistant turns).
CHAT_STYLES = {
    "one_sep": ("{s} ", "{r}: {t} ", "{r}: {t} "),
    "two_sep": ("{s} ", "{r}: {t} ", "{r}: {t}</s>"),
    "newline": ("{s}\n", "{r}\n{t}\n", "{r}\n{t}\n"),
    "no_colon": ("{s}", "{r}{t}", "{r}{t}"),
    "blocks": ("<|system|>\n{s}\n", "<|{r}|>\n{t}\n", "<|{r}|>\n{t}\n"),
}


def render_chat(df: DataFrame, style: str, system: str = "", key: str = "conv_id") -> DataFrame:
    """(key, prompt): a conversation's turns in order, each rendered by the style."""
    return render_chats(df, [style], system, key).drop("style")


def render_chats(df: DataFrame, styles: list[str], system: str = "", key: str = "conv_id") -> DataFrame:
    """(key, prompt, style): each conversation in each of the styles; its turns are brought together once."""

    def prompt(style: str) -> Column:
        head, user, assistant = CHAT_STYLES[style]

        def line(turn: Column) -> Column:
            fill = lambda template: F.concat(*[turn[{"{r}": "role", "{t}": "text"}[p]] if p in ("{r}", "{t}") else F.lit(p) for p in _parts(template)])
            return F.struct(turn["turn"].alias("turn"), F.when(turn["role"] == "user", fill(user)).otherwise(fill(assistant)).alias("line"))

        lines = F.sort_array(F.transform("turns", line))["line"]
        return F.struct(F.concat(F.lit(head.replace("{s}", system)), F.array_join(lines, "")).alias("prompt"), F.lit(style).alias("style"))

    turns = df.groupBy(key).agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    return turns.select(key, F.explode(F.array(*map(prompt, styles))).alias("p")).select(key, "p.*")


def _parts(template: str) -> list[str]:
    import re

    return [p for p in re.split(r"(\{[rt]\})", template) if p]


def split_preference_pair(chosen: Column, rejected: Column) -> dict[str, Column]:
    """Longest common prefix = shared history; the remainders are the two answers."""
    most = F.least(F.length(chosen), F.length(rejected))
    shared = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.floor(F.log2(F.greatest(most, F.lit(1)).cast("double"))).cast("int"), F.lit(0))),
        F.lit(0),
        lambda acc, i: acc
        + F.when(
            (acc + _bit(most, i) <= most)
            & (chosen.substr(F.lit(1), acc + _bit(most, i)) == rejected.substr(F.lit(1), acc + _bit(most, i))),
            _bit(most, i),
        ).otherwise(0),
    )
    return {
        "history": chosen.substr(F.lit(1), shared),
        "chosen_answer": chosen.substr(shared + 1, F.length(chosen)),
        "rejected_answer": rejected.substr(shared + 1, F.length(rejected)),
    }


def _bit(most: Column, i: Column) -> Column:
    """The i-th largest power of two not above ``most``: binary search from long to short steps."""
    top = F.floor(F.log2(F.greatest(most, F.lit(1)).cast("double")))
    return F.pow(F.lit(2.0), top - i).cast("int")


def fill_template(template: str, **columns: Column) -> Column:
    text = F.lit(template)
    for name, value in columns.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def few_shot_prompt(shots: DataFrame, header: str, key: str = "prompt_id", rank: str = "draw", text: str = "text") -> DataFrame:
    """(key, prompt): numbered shots in draw order under a header."""
    ordered = F.sort_array(F.collect_list(F.struct(rank, text)))
    line = lambda s: F.concat(F.lit("Example: "), flatten_whitespace(s[text]))
    return shots.groupBy(key).agg(ordered.alias("s")).select(
        key, F.concat(F.lit(header + "\n"), F.array_join(F.transform("s", line), "\n")).alias("prompt")
    )


def split_joint_label(y: Column, n: int = 5) -> tuple[Column, Column]:
    return F.floor(y / n).cast("int"), (y % n).cast("int")


def truncate_tokens(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def blank_tokens(text: Column, key: Column, p: float, seed) -> Column:
    tokens = F.transform(words(text), lambda t, i: F.when(uniform(seed, key, i) < p, F.lit("_")).otherwise(t))
    return F.array_join(tokens, " ")


def mask_positions(df: DataFrame, ratio: float, seed, key: str = "id", tokens: str = "tokens", batch: str = "batch",
                   special=("[CLS]", "[SEP]")) -> DataFrame:
    """(key, positions): in each batch every row masks int(shortest maskable length * ratio) places."""
    from pyspark.sql import Window as W

    long = df.select(batch, key, F.posexplode(tokens).alias("pos", "token")).filter(~F.col("token").isin(list(special)))
    sizes = long.groupBy(batch, key).count().groupBy(batch).agg(F.floor(F.min("count") * ratio).alias("m"))
    draw = F.row_number().over(W.partitionBy(key).orderBy(uniform(seed, F.col(key), F.col("pos")), "pos"))
    chosen = long.withColumn("draw", draw).join(sizes, batch).filter("draw <= m")
    return chosen.groupBy(key).agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def sliding_spans(df: DataFrame, max_len: int, stride: int, key: str = "id", tokens: str = "tokens") -> DataFrame:
    """(key, window, start, tokens): overlapping windows; the last one reaches the end."""
    n = F.size(tokens)
    count = F.greatest(F.ceil((n - max_len) / stride) + 1, F.lit(1)).cast("int")
    rows = df.select(key, tokens, F.explode(F.sequence(F.lit(0), count - 1)).alias("window"))
    start = (F.col("window") * stride).cast("int")
    return rows.select(key, "window", start.alias("start"), F.slice(tokens, start + 1, max_len).alias("tokens"))


def align_answer_span(start: Column, size: Column, answer_first: Column, answer_last: Column) -> tuple[Column, Column]:
    """Window-relative token span of the answer; (0, 0) when missing or not inside the window."""
    inside = (answer_first >= start) & (answer_last < start + size)
    pick = lambda x: F.when(F.coalesce(inside, F.lit(False)), x - start).otherwise(0).cast("int")
    return pick(answer_first), pick(answer_last)


def pair_text(c: Column, x: Column, separator: str = "[SEP]") -> Column:
    return F.concat_ws(separator, c, x)


FEEDBACK_TEMPLATE = "Question: {question}\nBetter answer: {chosen}\nWorse answer: {rejected}\nSay what the worse answer lacks."
REVISE_TEMPLATE = "Question: {question}\nAnswer: {answer}\nFeedback: {feedback}\nWrite a better answer."


def feedback_prompt(question: Column, chosen: Column, rejected: Column) -> Column:
    return fill_template(FEEDBACK_TEMPLATE, question=question, chosen=chosen, rejected=rejected)


def revise_prompt(question: Column, answer: Column, feedback: Column) -> Column:
    return fill_template(REVISE_TEMPLATE, question=question, answer=answer, feedback=feedback)


def name_hint(instruction: Column, entry_point: Column) -> Column:
    hint = F.concat(instruction, F.lit(" The function should be named "), entry_point, F.lit("."))
    return F.when(entry_point.isNotNull(), hint).otherwise(instruction)


def label_index(df: DataFrame, col: str) -> DataFrame:
    """(value, index): distinct values in order, numbered from 0."""
    from pyspark.sql import Window as W

    distinct = df.select(F.col(col).alias("value")).filter("value IS NOT NULL").distinct()
    return distinct.select("value", (F.row_number().over(W.orderBy("value")) - 1).cast("int").alias("index"))
