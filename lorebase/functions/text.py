"""Columns over questions, titles and answers. Each takes and returns a Column; none needs a UDF."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The domains in order of precedence, and the words that point to each.
DOMAIN_WORDS: dict[str, tuple[str, ...]] = {
    "心血管": ("心衰", "心力衰竭", "高血压", "冠心病", "心肌梗死", "房颤", "心律失常", "血脂", "胸痛", "冠脉", "心绞痛", "动脉硬化"),
    "呼吸": ("肺炎", "哮喘", "慢阻肺", "copd", "支气管", "肺栓塞", "呼吸衰竭", "咳嗽", "肺结核", "肺结节", "气胸"),
    "神经": ("卒中", "脑梗", "脑出血", "癫痫", "帕金森", "头痛", "眩晕", "面瘫", "痴呆", "蛛网膜", "脑炎", "脑积水"),
    "内分泌": ("糖尿病", "甲状腺", "甲亢", "甲减", "骨质疏松", "痛风", "尿酸", "胰岛素", "肾上腺", "垂体"),
    "消化": ("肝硬化", "肝炎", "胰腺炎", "胃炎", "溃疡", "肠炎", "消化道出血", "黄疸", "反流", "胆囊", "阑尾"),
    "肾脏": ("肾衰", "肾病", "透析", "肾小球", "尿毒症", "肌酐", "肾功能"),
    "血液": ("贫血", "白血病", "淋巴瘤", "血小板", "凝血", "血友病", "骨髓"),
    "感染": ("感染", "抗菌", "抗生素", "发热", "脓毒", "菌血症", "耐药", "结核", "病毒"),
    "肿瘤": ("肿瘤", "癌", "瘤", "化疗", "放疗", "靶向", "恶性"),
    "外科": ("手术", "创伤", "骨折", "阑尾炎", "疝", "胆结石", "痔", "烧伤", "关节", "外伤", "截肢"),
    "妇产": ("妊娠", "产科", "妇科", "月经", "分娩", "剖宫产", "宫颈", "胎盘"),
    "儿科": ("新生儿", "儿童", "小儿", "婴儿", "早产"),
    "急诊重症": ("心肺复苏", "休克", "中毒", "急救", "重症", "呼吸机", "除颤", "脓毒症", "多器官"),
    "影像检验": ("ct", "mri", "超声", "影像", "检验", "实验室", "病理", "x线", "内镜"),
    "口腔": ("口腔", "牙", "龋齿", "牙周", "牙龈", "种植牙", "正畸", "颌面"),
    "眼科": ("眼", "白内障", "青光眼", "视网膜", "近视", "角膜", "眼底", "视神经"),
    "耳鼻喉": ("耳", "鼻", "喉", "咽", "耳鸣", "中耳炎", "鼻炎", "扁桃体", "声带"),
    "皮肤": ("皮肤", "皮疹", "湿疹", "银屑病", "荨麻疹", "痤疮", "皮炎", "带状疱疹", "脱发"),
    "精神心理": ("抑郁", "焦虑", "失眠", "精神", "心理", "躁狂", "强迫", "幻听", "谵妄"),
    "康复": ("康复", "理疗", "物理治疗", "作业治疗", "吞咽训练", "运动疗法"),
    "风湿免疫": ("风湿", "类风湿", "红斑狼疮", "免疫", "干燥综合征", "痛风", "强直"),
    "骨科": ("骨", "关节", "脊柱", "腰椎", "颈椎", "骨折", "韧带", "半月板", "椎间盘"),
    "泌尿": ("泌尿", "前列腺", "膀胱", "尿路", "肾结石", "输尿管", "尿失禁", "精索"),
}
# Short names and the full names they stand for.
ALIASES: dict[str, tuple[str, ...]] = {
    "心衰": ("心力衰竭",), "心梗": ("心肌梗死",), "房颤": ("心房颤动",), "脑梗": ("脑梗死",), "慢阻肺": ("慢性阻塞性肺疾病",),
    "copd": ("慢性阻塞性肺疾病",), "呼衰": ("呼吸衰竭",), "肾衰": ("肾功能衰竭",), "冠心病": ("冠状动脉粥样硬化性心脏病",), "心功能不全": ("心力衰竭",),
}
# Words that are no keyword when they are a whole token.
STOP_TOKENS = ("的", "了", "是", "在", "和", "与", "或", "及", "等", "应", "需", "为", "有", "不", "未", "对", "中", "上", "下", "该", "此", "其", "之", "怎么", "如何", "什么", "哪些", "多少", "可以", "能否", "是否")
# Kinds of questions by precedence.
QUESTION_KINDS = (("differential", "鉴别|区分|如何区分"), ("diagnosis", "诊断|标准|分型|分级|分期|定义|分类|依据"), ("treatment", "治疗|用药|方案|干预|处理|管理|防治|控制"), ("drug", "药|剂量|用法|禁忌|不良反应|副作用"))
# What opens a clean title, taken off in this order.
TITLE_STARTS = (r"^第[一二三四五六七八九十百千万\d]+[章节篇部分]+\s*", r"^[A-Za-z]\d+(\.\d+)?\s*", r"^\d+[\.、）)]\s*", r"^[一二三四五六七八九十]+[、．.]\s*", r"^[（(][^（()）]*[)）]\s*", "[《》\"“”]")
# Words of titles without content of their own.
SKIP_WORDS = ("概述", "前言", "附录", "目录", "总论", "总则", "参考文献", "索引", "后记", "序言", "致谢", "编写说明", "使用说明", "编写人员", "出版说明", "缩略语", "目 录", "说明", "序", "跋", "编委会", "名词术语")
# What parts tokens, and how an answer says what it lacks.
PUNCTUATION = r"[【】、。，；：！？\s,.;:!()\[\]（）\"'“”‘’]"
CJK = r"[一-龥]"
GAPS = ("关于[【「『“\"'(]?([^】」』”\"')，。；、]{1,30})[】」』”\"')]?的内容有限", "未涉及([^，。；、]{1,20})")
# Endings of titles that name a department, and titles of punctuation alone.
NO_TITLES = ("系统|科$|学$|类质控$", r"^[，。、；：！？,.!?;\s]+$")


def first_match(text: Column, kinds: Sequence[tuple[str, str]]) -> Column:
    """Name of the first pattern found in ``text``, else null."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(n)) for n, p in kinds))


def classify_domain(text: Column, domains: Mapping[str, Sequence[str]] | None = None) -> Column:
    """K7: first domain with a word contained in the lower-cased text, null otherwise."""
    low = F.lower(text)
    cases = []
    for name, words in (domains or DOMAIN_WORDS).items():
        found = F.lit(False)
        for w in words:
            found = found | F.contains(low, F.lit(w.lower()))
        cases.append(F.when(found, F.lit(name)))
    return F.coalesce(*cases)


def classify_question(text: Column) -> Column:
    """K8: differential, diagnosis, treatment, drug, else general."""
    return F.when(text.isNotNull(), F.coalesce(first_match(text, QUESTION_KINDS), F.lit("general")))


def windows(token: Column, size: int, step: int = 1) -> Column:
    """All ``size``-character pieces of ``token``, every ``step`` characters; empty where it is shorter."""
    last = F.length(token) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1, F.lit(step)), lambda i: F.substring(token, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Pieces of two characters or more between punctuation and white space."""
    return F.filter(F.split(F.regexp_replace(text, PUNCTUATION, " "), r"\s+"), lambda t: F.length(t) >= 2)


def weighted_keywords(text: Column) -> Column:
    """K2, before the maximum: array of (kw, weight) of a question, with repetitions."""

    def weigh(kws: Column, weight: int) -> Column:
        return F.transform(F.filter(kws, lambda k: F.length(k) >= 2), lambda k: F.struct(k.alias("kw"), F.lit(weight).alias("weight")))

    def of_token(t: Column) -> Column:
        around = F.when(F.contains(t, F.lit("的")), F.split(t, "的")).otherwise(F.array().cast("array<string>"))
        whole = F.when(~t.isin(*STOP_TOKENS), F.array(t)).otherwise(F.array().cast("array<string>"))
        pairs = F.filter(windows(t, 2), lambda w: F.substring(w, 1, 1).rlike(CJK))
        return F.concat(weigh(around, 3), weigh(whole, 3), weigh(windows(t, 4, 2), 2), weigh(pairs, 1))

    return F.flatten(F.transform(tokens(text), of_token))


def window_keywords(text: Column, sizes: Sequence[int] = (2, 3, 4), stop: Sequence[str] = STOP_TOKENS) -> Column:
    """K4: short or non-CJK tokens whole, longer ones as windows of each size; duplicates stay."""

    def of_token(t: Column) -> Column:
        parts = F.concat(*(F.filter(windows(t, n), lambda w: ~w.isin(*stop)) if n == 2 else windows(t, n) for n in sizes))
        return F.when((F.length(t) <= 4) | ~F.substring(t, 1, 1).rlike(CJK), F.array(t)).otherwise(parts)

    return F.flatten(F.transform(tokens(text), of_token))


def expand_aliases(terms: Column, aliases: Mapping[str, Sequence[str]] | None = None) -> Column:
    """K6: each term followed by its full names, distinct."""
    known = F.create_map(*(x for k, v in (aliases or ALIASES).items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.array_distinct(F.flatten(F.transform(terms, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(known, F.lower(t)), F.array().cast("array<string>"))))))


def normalize_question(text: Column) -> Column:
    """Without punctuation and white space, lower case."""
    return F.lower(F.regexp_replace(text, r"[？，。、；：！\s,.;:!?()\[\]（）【】\"'“”‘’]", ""))


def clean_title(text: Column) -> Column:
    """Without chapter marks, codes, numbers, a bracketed start and quotes."""
    out = F.trim(F.coalesce(text, F.lit("")))
    for p in TITLE_STARTS:
        out = F.regexp_replace(out, p, "")
    return F.trim(out)


def meaningful_title(text: Column, skip: Sequence[str] = SKIP_WORDS) -> Column:
    """2 to 12 characters, none of the ``skip`` words, no department or field name, not just punctuation."""
    found = F.lit(False)
    for w in skip:
        found = found | F.contains(text, F.lit(w))
    return (F.length(text).between(2, 12) & ~found & ~text.rlike(NO_TITLES[0]) & ~text.rlike(NO_TITLES[1])).alias("meaningful")


def coverage_gap(answer: Column) -> Column:
    """What an answer says it lacks, else null."""
    said, left = (F.regexp_extract(answer, p, 1) for p in GAPS)
    gap = F.trim(F.coalesce(F.nullif(said, F.lit("")), F.nullif(left, F.lit(""))))
    return F.when((F.length(answer) >= 30) & (gap != "") & ~gap.rlike(r"^[\d\s]+$"), gap)


def pieces(text: Column, size: int) -> Column:
    """All pieces of ``size`` characters, with repetitions; characters are taken apart once, so that long texts cost their length."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    out = chars
    for k in range(1, size):
        out = F.zip_with(out, F.slice(chars, F.lit(k + 1), F.greatest(F.size(chars), F.lit(0))), lambda a, b: F.concat(a, b))
    return F.filter(out, lambda w: w.isNotNull())


def ngrams(text: Column, size: int = 2) -> Column:
    """K1 without a lexicon: distinct CJK n-grams in order."""
    return F.filter(F.array_distinct(pieces(F.regexp_replace(text, r"\s+", " "), size)), lambda w: w.rlike(f"^{CJK}{{{size}}}$"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one is null or zero, or the lengths differ."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm), F.lit(0.0))
