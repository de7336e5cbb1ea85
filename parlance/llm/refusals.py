"""Sentences that decline to translate, told from ordinary ones by logistic regression on words and pairs of words.

The model never sees a refusal of the data: it is fitted on sentences composed from frames (an opening, who can't or won't,
what, and with which text), on a bounded sample of ordinary sentences, and on ordinary ones that decline something else.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

from parlance.llm.langid import CACHE, Grown, words_of
from parlance.llm.sentences import nfc

#: What refusals are composed of, by language. {a} is an act, {o} its object.
FRAMES: dict[str, dict[str, tuple[str, ...]]] = {
    "en": {
        "open": ("", "", "Sorry, ", "I'm sorry, but ", "I am sorry, but ", "I apologize, but ", "My apologies, ", "Apologies, but ", "Unfortunately, ", "Unfortunately ", "Regrettably, ", "I'm afraid ", "As an AI, ", "As an AI assistant, ", "As an AI assistant ", "As a language model, ", "As an artificial intelligence, ", "Due to my guidelines, ", "For privacy reasons, ", "Because this is confidential, "),
        "core": ("I can't {a} {o}.", "I cannot {a} {o}.", "I am not able to {a} {o}.", "I'm not able to {a} {o}.", "I am unable to {a} {o}.", "I'm unable to {a} {o}.", "I won't {a} {o}.", "I will not {a} {o}.", "I won't be able to {a} {o}.", "I must decline to {a} {o}.", "I have to decline {o}.", "I must refuse to {a} {o}.", "I am not allowed to {a} {o}.", "I'm not permitted to {a} {o}.", "I would rather not {a} {o}.", "I prefer not to {a} {o}.", "I don't feel comfortable when asked to {a} {o}.", "it is not possible for me to {a} {o}.", "I could not {a} {o}.", "{o} is something I can't {a}.", "{o} is not something I am able to {a}.", "{o} violates my guidelines.", "{o} goes against the usage policy.", "{o} conflicts with the content policy and I will not go on.", "{o} is beyond what I can {a}.", "{o} cannot be translated by me.", "I can't offer a translation of {o}.", "I cannot provide a translation for {o}.", "no translation of {o} can be given.", "no translation will be provided for {o}.", "I have to leave {o} untranslated.", "{o} looks sensitive, so I will leave it as it is.", "{o} seems confidential and I have to stop here.", "please ask a professional translator, I can't {a} {o}.", "please consult a human translator about {o}."),
        "act": ("translate", "translate", "translate", "help with", "assist with", "process", "work on", "handle", "answer", "fulfil", "comply with", "render", "support", "respond to", "complete", "continue with"),
        "object": ("this text", "this content", "this document", "this passage", "this message", "this material", "this request", "that request", "your request", "such content", "such requests", "such a document", "documents of this kind", "texts like this", "personal data", "private information", "sensitive information", "confidential material", "it", "this"),
    },
    "fr": {
        "open": ("", "", "Désolé, ", "Désolée, mais ", "Je suis désolé, mais ", "Je regrette, mais ", "Je m'excuse, mais ", "Malheureusement, ", "En tant qu'IA, ", "En tant qu'assistant IA, ", "En tant que modèle de langage, ", "En tant qu'assistant, ", "Pour des raisons de confidentialité, "),
        "core": ("je ne peux pas {a} {o}.", "je ne peux {a} {o}.", "je ne suis pas en mesure de {a} {o}.", "je ne suis pas autorisé à {a} {o}.", "il m'est impossible de {a} {o}.", "je dois refuser de {a} {o}.", "je refuse de {a} {o}.", "je préfère ne pas {a} {o}.", "je ne souhaite pas {a} {o}.", "je ne pourrai pas {a} {o}.", "je ne saurais {a} {o}.", "je dois décliner {o}.", "{o} est contraire à mes règles.", "{o} enfreint mes consignes.", "{o} dépasse ce que je peux faire.", "{o} semble sensible, je ne vais pas le traduire.", "je ne fournirai pas de traduction pour {o}.", "je ne peux pas fournir la traduction, car {o} est confidentiel.", "veuillez consulter un traducteur assermenté pour {o}.", "aucune traduction ne sera donnée pour {o}."),
        "act": ("traduire", "traduire", "traduire", "vous aider avec", "vous aider pour", "traiter", "répondre à", "donner suite à", "prendre en charge", "poursuivre avec"),
        "object": ("ce texte", "ce contenu", "ce document", "ce passage", "ce message", "cette demande", "cette requête", "votre demande", "de tels documents", "ce type de contenu", "des données personnelles", "des informations confidentielles", "des informations sensibles", "cela"),
    },
    "vi": {
        "open": ("", "", "Xin lỗi, ", "Rất tiếc, ", "Thành thật xin lỗi, ", "Rất xin lỗi, nhưng ", "Đáng tiếc là ", "Là trợ lý AI, ", "Là một AI, ", "Là mô hình ngôn ngữ, ", "Với tư cách là trợ lý ảo, ", "Vì lý do bảo mật, "),
        "core": ("tôi không thể {a} {o}.", "tôi không được phép {a} {o}.", "tôi không có khả năng {a} {o}.", "tôi xin từ chối {a} {o}.", "tôi xin phép không {a} {o}.", "tôi phải từ chối {a} {o}.", "tôi buộc phải từ chối {o}.", "tôi sẽ không {a} {o}.", "tôi chưa thể {a} {o}.", "mình không thể {a} {o}.", "em không thể {a} {o}.", "{o} vi phạm chính sách của tôi.", "{o} trái với nguyên tắc sử dụng.", "{o} nằm ngoài phạm vi hỗ trợ.", "{o} vượt quá khả năng của tôi.", "{o} có vẻ nhạy cảm nên tôi không dịch.", "không thể cung cấp bản dịch cho {o}.", "vui lòng nhờ phiên dịch viên với {o}."),
        "act": ("dịch", "dịch", "dịch", "hỗ trợ", "giúp với", "xử lý", "thực hiện", "trả lời", "đáp ứng", "tiếp tục"),
        "object": ("văn bản này", "nội dung này", "tài liệu này", "đoạn này", "tin nhắn này", "yêu cầu này", "yêu cầu của bạn", "những nội dung như vậy", "dữ liệu cá nhân", "thông tin cá nhân", "thông tin nhạy cảm", "tài liệu mật", "điều này"),
    },
    "ja": {
        "open": ("", "", "申し訳ありませんが、", "申し訳ございませんが、", "すみませんが、", "恐れ入りますが、", "残念ながら、", "AIとして、", "AIアシスタントとして、", "言語モデルとして、", "私はAIなので、", "ガイドラインにより、"),
        "core": ("{o}を翻訳することはできません。", "{o}は翻訳できません。", "{o}の翻訳はできかねます。", "{o}の翻訳はいたしかねます。", "{o}の翻訳はお断りいたします。", "{o}の翻訳は控えさせていただきます。", "{o}の翻訳はご遠慮いたします。", "{o}にはお答えできません。", "{o}には対応できません。", "{o}には応じられません。", "{o}をお手伝いすることはできません。", "{o}については支援できません。", "{o}を処理することはできません。", "{o}は扱えません。", "{o}は方針に反するため、訳文を提供できません。", "{o}は規約に違反しています。", "{o}を訳すことは許可されていません。"),
        "act": ("",),
        "object": ("この内容", "この文章", "この文書", "このテキスト", "このメッセージ", "このご依頼", "ご依頼", "このリクエスト", "ご要望", "このような資料", "個人情報を含む内容", "個人情報", "機密情報", "それ"),
    },
    "ko": {
        "open": ("", "", "죄송하지만 ", "죄송합니다만 ", "미안하지만 ", "유감스럽게도 ", "안타깝지만 ", "AI로서 ", "저는 AI이므로 ", "저는 인공지능이기 때문에 ", "언어 모델로서 ", "지침에 따라 "),
        "core": ("{o} 번역할 수 없습니다.", "{o} 번역해 드릴 수 없습니다.", "{o} 번역하지 않겠습니다.", "{o} 도와드릴 수 없습니다.", "{o} 도와드리기 어렵습니다.", "{o} 처리할 수 없습니다.", "{o} 응할 수 없습니다.", "{o} 답변드릴 수 없습니다.", "{o} 지원할 수 없습니다.", "{o} 거절합니다.", "{o} 거부할 수밖에 없습니다.", "{o} 제공할 수 없습니다.", "{o} 정책에 위반됩니다.", "{o} 규정에 맞지 않아 번역을 제공하지 않습니다.", "{o} 다룰 수 없습니다."),
        "act": ("",),
        "object": ("이 내용은", "이 글은", "이 문서는", "이 텍스트를", "이 메시지는", "이 요청은", "이 요청에", "요청하신 내용은", "그 부탁은", "이런 자료는", "개인 정보가 포함된 내용은", "개인정보는", "민감한 정보는", "이것은"),
    },
    "zh": {
        "open": ("", "", "抱歉，", "很抱歉，", "对不起，", "非常抱歉，", "不好意思，", "很遗憾，", "作为AI，", "作为人工智能，", "作为语言模型，", "我是AI助手，", "出于隐私考虑，"),
        "core": ("我无法翻译{o}。", "我不能翻译{o}。", "我没有办法翻译{o}。", "我无法处理{o}。", "我不能处理{o}。", "我无法协助{o}。", "我不能帮助您完成{o}。", "我不便翻译{o}。", "我必须拒绝{o}。", "我只能拒绝{o}。", "我不被允许翻译{o}。", "我无法回答{o}。", "我无法满足{o}。", "{o}违反了使用政策。", "{o}不符合我的准则。", "{o}超出了我的能力范围。", "无法为{o}提供翻译。", "不能为{o}提供译文。", "恕我不能翻译{o}。"),
        "act": ("",),
        "object": ("这段内容", "这段文字", "此内容", "这份文件", "该文件", "这条消息", "这个请求", "您的请求", "该请求", "这样的材料", "含有个人信息的内容", "个人信息", "敏感信息", "机密材料"),
    },
}
#: Ordinary sentences that decline or can't do something, by language, which are none.
OTHERWISE: dict[str, tuple[str, ...]] = {
    "en": ("We cannot accept the offer.", "I'm sorry, but I cannot attend the meeting.", "Unfortunately, the request was rejected by the office.", "I regret that we must decline your application.", "The tenant is not able to pay the rent.", "I am unable to open the attachment.", "Sorry for the late reply.", "We are sorry that the delivery is late.", "The translation of the contract is ready.", "Please translate this document by Monday.", "I will not sign this document.", "The company is not allowed to process the payment.", "Can you translate this letter?", "The policy covers damage by water.", "We won't be able to deliver the goods on time."),
    "fr": ("Nous ne pouvons pas accepter cette offre.", "Je suis désolé, mais je ne peux pas venir à la réunion.", "Malheureusement, la demande a été refusée par le bureau.", "Je ne peux pas ouvrir la pièce jointe.", "Nous devons refuser votre candidature.", "La traduction du contrat est prête.", "Pouvez-vous traduire ce document avant lundi ?", "Je ne signerai pas ce document.", "Le locataire ne peut pas payer le loyer."),
    "vi": ("Chúng tôi không thể chấp nhận đề nghị này.", "Xin lỗi, tôi không thể dự cuộc họp.", "Rất tiếc, đơn đã bị văn phòng từ chối.", "Tôi không mở được tệp đính kèm.", "Chúng tôi phải từ chối hồ sơ của bạn.", "Bản dịch hợp đồng đã xong.", "Bạn có thể dịch tài liệu này trước thứ hai không?", "Tôi sẽ không ký tài liệu này.", "Người thuê không thể trả tiền thuê."),
    "ja": ("この提案を受け入れることはできません。", "申し訳ありませんが、会議に出席できません。", "残念ながら、申請は却下されました。", "添付ファイルを開くことができません。", "契約書の翻訳ができました。", "この書類を月曜日までに翻訳してください。", "この書類には署名しません。", "借主は家賃を支払うことができません。"),
    "ko": ("이 제안을 받아들일 수 없습니다.", "죄송하지만 회의에 참석할 수 없습니다.", "유감스럽게도 신청이 거부되었습니다.", "첨부 파일을 열 수 없습니다.", "계약서 번역이 끝났습니다.", "이 서류를 월요일까지 번역해 주세요.", "이 서류에 서명하지 않겠습니다.", "세입자가 집세를 낼 수 없습니다."),
    "zh": ("我们不能接受这个报价。", "很抱歉，我不能参加会议。", "很遗憾，申请被办事处拒绝了。", "我打不开附件。", "合同的翻译已经完成。", "请在星期一之前翻译这份文件。", "我不会签署这份文件。", "承租人无法支付房租。"),
}
#: Sentences composed per language, and most ordinary sentences the model is fitted on.
COMPOSED, ORDINARY = 600, 8_000
#: Log odds above which a sentence declines.
DECLINES = 0.0
def composed(rng: random.Random, lang: str, count: int) -> Iterator[str]:
    """Refusals put together from the frames of a language."""
    own = FRAMES[lang]
    for _ in range(count):
        opening, core = rng.choice(own["open"]), rng.choice(own["core"])
        body = core.format(a=rng.choice(own["act"]), o=rng.choice(own["object"]))
        if opening and body.startswith("I ") or not opening.endswith((", ", "but ", "que ", "là ")):
            text = opening + body
        else:
            text = opening + body[:1].lower() + body[1:]
        yield text[:1].upper() + text[1:]


def _edges(word: str) -> tuple[str, str]:
    """What a word is to the one before it and to the one after it: its outer characters in scripts without spaces, else the word."""
    return (word[0], word[-1]) if word[0] > "\u2fff" else (word, word)


def _inside(word: str) -> list[str]:
    """The word itself; of scripts without spaces its runs of one to three characters."""
    return [word[i : i + k] for k in (1, 2, 3) for i in range(len(word) - k + 1)] if word[0] > "\u2fff" else [word]


def grams(words: list[str]) -> list[str]:
    """What stands inside words, and pairs of neighbours."""
    return [g for w in words for g in _inside(w)] + [f"{_edges(a)[1]} {_edges(b)[0]}" for a, b in zip(words, words[1:])]


class Refusals:
    """Weights per gram; fitted on composed refusals and at most ORDINARY sentences."""

    def __init__(self, ordinary: Iterable[str], seed: int = 0):
        rng = random.Random(seed)
        texts = [(t, 1.0) for lang in FRAMES for t in composed(rng, lang, COMPOSED)]
        texts += [(t, 0.0) for own in OTHERWISE.values() for t in own for _ in range(20)]
        texts += [(t, 0.0) for t, _ in zip(ordinary, range(ORDINARY), strict=False)]
        self.weights, self.base = _fitted([(words_of(nfc(t)), y) for t, y in texts])
        pairs = [(_hash(g), w) for g, w in self.weights.items() if " " in g]
        keys = np.array([k for k, _ in pairs], np.uint64)
        order = np.argsort(keys)
        self.keys, self.pair_weights = keys[order], np.array([w for _, w in pairs])[order]
        self._forget()

    def _forget(self) -> None:
        self.cache: dict[str, int] = {}
        # per known word: sum of the weights inside, number of grams inside, hashes of both edges
        self.sums, self.counts, self.left, self.right = Grown(float), Grown(float), Grown(np.uint64), Grown(np.uint64)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("cache", "sums", "counts", "left", "right")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _number(self, word: str) -> int:
        if (n := self.cache.get(word)) is None:
            inside = _inside(word)
            a, b = _edges(word)
            self.sums.add(sum(self.weights.get(g, 0.0) for g in inside))
            self.counts.add(len(inside))
            self.left.add(_part(a))
            self.right.add(_part(b))
            n = self.cache[word] = len(self.cache)
        return n

    def scores_words(self, rows: list[list[str]]) -> np.ndarray:
        """Log odds that each sentence, given by its words, declines; grams that the model doesn't know count nothing."""
        if len(self.cache) >= CACHE:
            self._forget()
        get, flat, sizes = self.cache.get, [], []
        for words in rows:
            ids = list(map(get, words))
            if None in ids:
                ids = [self._number(w) if n is None else n for w, n in zip(words, ids, strict=True)]
            flat.extend(ids)
            sizes.append(len(ids))
        out = np.full(len(rows), -9.0)
        if not flat:
            return out
        at, row = np.asarray(flat), np.repeat(np.arange(len(rows)), sizes)
        total = np.bincount(row, weights=self.sums[at], minlength=len(rows))
        number = np.bincount(row, weights=self.counts[at], minlength=len(rows))
        near = np.flatnonzero(row[1:] == row[:-1])
        if len(near):
            keys = _joined(self.right[at[near]], self.left[at[near + 1]])
            hit = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
            weight = np.where(self.keys[hit] == keys, self.pair_weights[hit], 0.0) if len(self.keys) else np.zeros(len(keys))
            total += np.bincount(row[near], weights=weight, minlength=len(rows))
            number += np.bincount(row[near], minlength=len(rows))
        some = number > 0
        out[some] = self.base + total[some] / np.sqrt(number[some])
        return out

    def scores(self, sentences: list[str]) -> list[float]:
        return self.scores_words([words_of(nfc(s)) for s in sentences]).tolist()

    def declines(self, sentence: str) -> bool:
        return self.scores([sentence])[0] > DECLINES


def _part(edge: str) -> int:
    return xxhash.xxh64_intdigest(edge.encode("utf-8", "surrogatepass"))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return a * np.uint64(0x9E3779B97F4A7C15) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7))


def _hash(pair: str) -> int:
    a, b = pair.split(" ")
    return int(_joined(np.array([_part(a)], np.uint64), np.array([_part(b)], np.uint64))[0])


def _fitted(texts: list[tuple[list[str], float]], rounds: int = 300, prior: float = 0.0002) -> tuple[dict[str, float], float]:
    """Logistic regression with a Gaussian prior by Adam; a sentence's grams are scaled by the root of their number."""
    number: dict[str, int] = {}
    rows, columns, values = [], [], []
    for k, (words, _) in enumerate(texts):
        g = grams(words)
        rows += [k] * len(g)
        columns += [number.setdefault(x, len(number)) for x in g]
        values += [max(1, len(g)) ** -0.5] * len(g)
    r, c, v, y = np.array(rows), np.array(columns), np.array(values), np.array([y for _, y in texts])
    # both kinds weigh the same
    share = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    w, b = np.zeros(len(number)), 0.0
    m, q = np.zeros(len(number) + 1), np.zeros(len(number) + 1)
    for step in range(1, rounds + 1):
        z = b + np.bincount(r, weights=v * w[c], minlength=len(y))
        d = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.append(np.bincount(c, weights=v * d[r], minlength=len(number)) + prior / len(number) ** 0.5 * w, d.sum())
        m, q = 0.9 * m + 0.1 * g, 0.999 * q + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return {x: float(w[k]) for x, k in number.items() if abs(w[k]) > 1e-3}, float(b)
