"""Word lists, patterns, limits and formats that scores and texts depend on.

Results agree with other users of these rules only if the values below stay as they are.
"""

# Whitespace and decimal digits as every script writes them, for Java and RE2 alike.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_SET = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
S = f"[{_SET}]"
D = r"\p{Nd}"

# Regular expressions. (?d) keeps . and ^ to \n, (?U) makes \w and \b Unicode-aware.
BOXED = r"\\boxed\{([^}]+)\}"
FLAT_OBJECT = r"\{[^{}]*\}"
NUMBER = rf"-?{D}+\.?{D}*"
ARITHMETIC = rf"{D}+{S}*[+\-*/]{S}*{D}+{S}*={S}*{D}+"
MARKDOWN = [rf"(?dm)^#+{S}", r"(?dm)\*\*.*\*\*", r"```"]
STEP_FORMATS = [rf"步骤{S}*{D}", rf"Step{S}*{D}", rf"{D}+\.{S}+"]

# Answer markers, in the order they are tried.
COMMON_MARKERS = ["####", "答案", "Answer:"]
GRPO_MARKERS = ["####", "答案:", "答案：", "Answer:", "answer:", "The answer is"]
GSPO_MARKERS = ["####", "答案:", "答案：", "Answer:", "answer:", "The answer is", "最终答案"]

# Reasoning steps: how many of these patterns occur (grpo), how often they occur (gspo).
GRPO_STEPS = [
    rf"第[一二三四五六七八九十{D}]+步",
    rf"Step{S}*{D}+",
    rf"{D}+\.{S}+",
    r"首先|然后|接着|最后",
    r"First|Then|Next|Finally",
]
GSPO_STEPS = [
    rf"第[一二三四五六七八九十{D}]+步",
    rf"Step{S}*{D}+",
    rf"{D}+\.{S}+",
    r"首先|然后|接着|最后|因此|所以",
    r"First|Then|Next|Finally|Therefore",
]
GSPO_CALCULATION = [rf"{D}+{S}*[+\-*/×÷]{S}*{D}+{S}*={S}*{D}+", rf"={S}*{D}+"]
GSPO_EXPLANATIONS = [
    "因为", "由于", "根据", "可知", "得到",
    "because", "since", "therefore", "thus", "hence",
]
GSPO_FUNCTION = rf"(?U)def{S}+\w+{S}*\([^)]*\){S}*:"
GSPO_DOCSTRINGS = [r'(?s)""".*?"""', r"(?s)'''.*?'''"]
GSPO_RETURN_TYPE = rf"(?U)->{S}*\w"
GSPO_POLITE = ["请", "谢谢", "您", "please", "thank", "sorry"]
GRPO_LABELS = ["positive", "negative", "neutral", "是", "否", "yes", "no"]

# Which data sources each rule set sends to which rule; anything else goes to "default".
COMMON_SOURCES = {
    "math": ["gsm8k", "math", "math_reasoning", "aime", "olympiad"],
    "code": ["code", "code_generation", "humaneval", "mbpp"],
    "qa": ["qa", "trivia", "squad", "natural_questions"],
    "format": ["json_output", "structured"],
}
GRPO_SOURCES = {
    "math": ["math_reasoning", "gsm8k", "math", "aime"],
    "code": ["code", "code_generation", "humaneval"],
    "qa": ["qa", "trivia", "natural_questions"],
    "label": ["classification", "sentiment"],
}
GSPO_SOURCES = {
    "math": ["math_reasoning", "gsm8k", "math", "aime", "olympiad"],
    "code": ["code", "code_generation", "humaneval"],
    "qa": ["qa", "trivia", "natural_questions"],
    "dialogue": ["dialogue", "conversation", "chat"],
}

# Weighted reward of a model score and a rule score.
MODEL_RULE_WEIGHTS = {"rm_score": 0.7, "rule_score": 0.3}
REQUIRED_MARKERS = ["答案", "\\boxed"]
MARKER_BONUS = 0.1

# Console log patterns, tried on every line.
CONSOLE_PATTERNS = {
    "step": rf"(?iu)step[:{_SET}]+({D}+)",
    "epoch": rf"(?iu)epoch[:{_SET}]+({D}+)",
    "loss": rf"(?iu)loss[:{_SET}]+([{D}.]+)",
    "reward": rf"(?iu)reward[:{_SET}]+([{D}.]+)",
    "kl": rf"(?iu)kl[:{_SET}]+([{D}.]+)",
    "lr": rf"(?iu)lr[:{_SET}]+([{D}.e-]+)",
}

# Dashboard metric groups.
METRIC_CATEGORIES = {
    "loss": ["policy_loss", "value_loss", "kl_loss", "entropy_loss"],
    "reward": ["reward_mean", "reward_std", "reward_max", "reward_min"],
    "kl": ["kl_divergence", "kl_coef", "kl_loss"],
    "progress": ["step", "epoch", "learning_rate", "grad_norm"],
    "system": ["gpu_utilization", "gpu_memory_used", "gpu_memory_total", "throughput"],
    "generation": ["response_length_mean", "response_length_std", "format_accuracy"],
}

# Alert rules (name, metric, condition, threshold, message) and the look-back of the stagnation rule.
ALERT_RULES = [
    ("kl_too_high", "kl_divergence", "greater_than", 0.1,
     "KL散度过高，可能需要调整学习率或KL系数"),
    ("gpu_low_utilization", "gpu_utilization", "less_than", 50.0,
     "GPU利用率较低，考虑增大batch size"),
]
STAGNATION_RULE = ("reward_stagnant", "reward_mean", 100, "奖励已经100步没有提升")

# Healthy ranges (metric, low, high); None leaves a side open, an open low end is exclusive for accuracy.
HEALTH_RANGES = [
    ("kl_divergence", 0.001, 0.1),
    ("kl_loss", 0.001, 0.1),
    ("clip_fraction", 0.1, 0.3),
    ("preference_accuracy", 0.6, None),
]
