"""A deterministic dirtied text for the synthetic documents, which have none of what the normalization and the lexicon look for.

DIRTY is one SQL expression over (doc_id, text) that Spark and DuckDB read alike.
"""

_NL = "chr(10)"
_FRAGMENTS = [
    # Breaks, a page number, references, dashes, hyphenation.
    ["'Первый абзац — это проверка‑разметки, в нём больше восьми слов и ссылка [см. 5], [1, 2-3] и год [1937].'", _NL, "'12'", _NL, "'Продол-'", _NL, "'жение текста на стр. 45 и далее идёт обычная строка из многих слов для проверки слияния строк.'"],
    # Direct and strong categories.
    ["chr(13)||chr(10)", "'Сталин и его окружение начали репрессии в 1937 году, НКВД и ГУЛАГ стали символами эпохи, и об этом написаны многие учебники истории для школы.'", _NL, "' '", _NL, "'Ещё одна строка: голод 1932 и 1933 годов. Конец.'"],
    # City only, no leader; years alone.
    ["'Битва под Сталинградом шла зимой, и город выстоял в тяжёлых боях, о чём рассказано в 1946 и 1948 годах в разных книгах и статьях.'", "chr(12)", "'Годы 1929, 1930 и 1938 названы здесь без всякой темы, просто как числа среди слов этого длинного предложения для проверки.'"],
    # Events and years; trials.
    ["'Коллективизация и индустриализация, пятилетний план и стахановское движение описаны в главе, г. Москва, 1934 г. и т.д. для примера в тексте.'", _NL, _NL, "'Московский процесс и дело врачей, Каменев и Зиновьев, Бухарин и Рыков упомянуты авторами в одном длинном предложении учебника.'"],
    # Ties, cult, weak.
    ["'Культ личности и вождь народов, репрессированные и враги народа: в этом предложении слова двух разделов стоят рядом для проверки равенства.'", _NL, _NL, "'Коба упомянут в 1939 году, но больше в этом абзаце ничего нет, кроме обычных слов и чисел, нужных для длины.'"],
    # Sentences with abbreviations, quotes, brackets.
    ["'Он сказал: \"Да.\" Потом (не сразу.) ответил проф. Иванов, и в 1953 г. вышла книга; см. также др. работы и т.п. тексты! Так ли это? Да. Нет. Может быть. Конец первого. Конец второго. Троцкисты и ежовщина забыты.'"],
    # Glued years, yo, spaces.
    ["'Ссылка и  депортация в 19370 и 1937г, партийные чистки, тройка и выселение народов ещё в 1949-м году описаны в этой строке текста.'", _NL, "'- 7 -'", _NL, "'Массовый террор и большой террор, арестованы в 1938 и расстреляны, социалистическое соревнование и ударники труда.'"],
    # Just the least score.
    ["'Депортация этой семьи описана в одной главе книги, и больше ничего о том времени автор учебника здесь не сообщает читателям.'"],
    ["'Обычный текст без всяких признаков темы, в нём просто достаточно слов, чтобы стать отдельным сегментом после деления.'"],
]

_CASES = " ".join(f"when {i} then {'||'.join(parts)}" for i, parts in enumerate(_FRAGMENTS))
#: Half of the texts get blank lines between their lines, so that they have paragraphs.
DIRTY = (
    f"case when doc_id % 2 = 0 then replace(text, {_NL}, {_NL}||{_NL}) else text end || {_NL} || {_NL} || "
    f"case cast(doc_id % {len(_FRAGMENTS)} as int) {_CASES} end || {_NL} || {_NL} || "
    "'Последний абзац документа состоит из нескольких слов и служит проверкой, номер его ' || cast(doc_id as varchar(20)) || '.'"
)
