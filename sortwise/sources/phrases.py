"""The phrase dimension used to turn the ``events`` table into a message stream.

FIXED VALUES: one Portuguese phrase per reachable rule, with the rule that
wins it, the cascade verdict and the verdict after reclassification
(C4).  ``msg_stream`` joins ``events`` to this table on
``(event_id * event_id + user_id) % 37`` so every phrase recurs, with
repeats of the same text inside one hour (what the TTL analysis needs).
"""

PHRASES = [
    (0, "R01", "oi", "user", "user"),
    (1, "R02", "sim", "user", "user"),
    (2, "R03", "sei la", "unclear", "unclear"),
    (3, "R04", "documento", "unclear", "unclear"),
    (4, "R05", "isso", "unclear", "unclear"),
    (5, "R06", "quando", "unclear", "unclear"),
    (6, "R07", "abcd", "unclear", "unclear"),
    (7, "R08", "um teste aqui", "unclear", "unclear"),
    (8, "R09", "perfeito, muito bom", "messages", "messages"),
    (9, "R10", "faz o resto pra mim", "unclear", "unclear"),
    (10, "R11", "manda pra ela", "unclear", "unclear"),
    (11, "R12", "usa o mesmo jeito de antes", "unclear", "unclear"),
    (12, "R13", "da um jeito nessa planilha", "unclear", "unclear"),
    (13, "R14", "me avise quando puder", "unclear", "unclear"),
    (14, "R15", "gera o relatorio", "unclear", "unclear"),
    (15, "R16", "cria um resumo de novo", "unclear", "unclear"),
    (16, "R17", "envia a planilha", "unclear", "unclear"),
    (17, "R18", "salva na planilha", "unclear", "unclear"),
    (18, "R19", "quero criar e enviar a pauta", "unclear", "unclear"),
    (19, "R20", "corrige a conta", "unclear", "unclear"),
    (20, "R21", "Gostaria muito de aprender mais sobre inteligência artificial. Você poderia me "
                "ajudar a entender melhor os conceitos fundamentais e como posso aplicar isso na "
                "minha vida profissional?", "user", "user"),
    (21, "R22", "nao sei se quero gerar a fatura", "unclear", "unclear"),
    (22, "R23", "antes ou depois do almoco?", "unclear", "unclear"),
    (23, "R24", "você pode enviar email?", "messages", "messages"),
    (24, "R25", "limpa o cache da sessao", "system", "messages"),
    (25, "R26", "abre meu google drive", "user", "user"),
    (26, "R27", "agende uma reunião amanhã", "system", "system"),
    (27, "R28", "maria enviou o convite ontem para todos", "user", "user"),
    (28, "R29", "melhorar minha rotina de estudos", "user", "user"),
    (29, "R30", "me ajude com algo", "messages", "messages"),
    (30, "R31", "tudo bem com você?", "user", "user"),
    (31, "R32", "viajaria se pudesse", "messages", "messages"),
    (32, "R33", "transfere o dinheiro", "system", "messages"),
    (33, "R34", "quanto e dois mais dois", "messages", "messages"),
    (34, "R35", "me conte sobre python", "messages", "messages"),
    (35, "R36", "quero um roteiro de viagem", "user", "user"),
    (36, "R37", "obra na avenida central", "user", "user"),
]
N_PHRASES = len(PHRASES)
SCHEMA = "idx int, rule string, message string, bucket string, final_bucket string"


def phrases_df(spark):
    return spark.createDataFrame(PHRASES, SCHEMA)
