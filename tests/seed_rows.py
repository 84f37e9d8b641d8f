"""Seed tables for golden tests.

Fixed values: the rows of the reference seed script, per model table (columns named as in the model;
AUTO_INCREMENT ids left out and numbered 1, 2, ... in the order given). Money as decimal.
"""

import datetime as dt
from decimal import Decimal

D = dt.date.fromisoformat

SEED = {
    "phone": [{"id": 1, "phone": "27999991111"}, {"id": 2, "phone": "27999992222"}, {"id": 3, "phone": "27999993333"},
              {"id": 4, "phone": "27999994444"}, {"id": 5, "phone": "27999995555"}],
    "address": [
        {"id": 1, "street": "Rua A, 123", "district": "Centro", "city": "Vitoria", "complement": "Apto 1"},
        {"id": 2, "street": "Rua B, 45", "district": "Praia da Costa", "city": "Vila Velha", "complement": "Casa"},
        {"id": 3, "street": "Av C, 900", "district": "Laranjeiras", "city": "Serra", "complement": "Bloco B"},
        {"id": 4, "street": "Rua D, 12", "district": "Campo Grande", "city": "Cariacica", "complement": "Fundos"},
        {"id": 5, "street": "Av E, 55", "district": "Jardim da Penha", "city": "Vitoria", "complement": "Casa 2"},
    ],
    "billing_period": [(1, "Mensal", 30), (2, "Bimestral", 60), (3, "Trimestral", 90), (4, "Semestral", 180),
                       (5, "Anual", 365)],
    "invoice_status": [(1, "Paga"), (2, "Pendente"), (3, "Atrasada"), (4, "Cancelada"), (5, "Isenta")],
    "person": [
        (1, "Carlos Silva", "111.111.111-11", "carlos@email.com", D("2010-05-10"), 1, 1),
        (2, "Maria Souza", "222.222.222-22", "maria@email.com", D("2008-08-20"), 2, 2),
        (3, "Joao Pedro", "333.333.333-33", "joao@email.com", D("2012-01-15"), 3, 3),
        (4, "Ana Clara", "444.444.444-44", "ana@email.com", D("1995-11-30"), 4, 4),
        (5, "Roberto Gomes", "555.555.555-55", "roberto@email.com", D("2000-02-25"), 5, 5),
        (6, "Fernanda Lima", "666.666.666-66", "fernanda@email.com", D("1985-07-12"), 1, 2),
        (7, "Lucas Alves", "777.777.777-77", "lucas@email.com", D("1990-09-05"), 2, 3),
        (8, "Juliana Costa", "888.888.888-88", "juliana@email.com", D("1988-12-10"), 3, 4),
        (9, "Marcos Paulo", "999.999.999-99", "marcos@email.com", D("1982-03-22"), 4, 1),
        (10, "Aline Barros", "000.000.000-00", "aline@email.com", D("1992-06-18"), 5, 2),
    ],
    "student": [(1, D("2023-01-10"), "Apto"), (2, D("2023-02-15"), "Apto"), (3, D("2023-03-20"), "Asma leve"),
                (4, D("2023-04-05"), "Apto"), (5, D("2023-05-12"), "Apto")],
    "instructor": [(6,), (7,), (8,), (9,), (10,)],
    "guardian": [(6,), (7,), (8,), (9,), (10,)],
    "sport": [(1, "Natacao", "Aulas em piscina aquecida", False), (2, "Futebol", "Futebol de campo", True),
              (3, "Volei", "Volei de quadra indoor", True), (4, "Basquete", "Basquete quadra oficial", True),
              (5, "Judo", "Artes marciais no tatame", False)],
    "qualified": [(1, 6), (2, 7), (3, 8), (4, 9), (5, 10)],
    "schedule": [(1, "Manha - 08:00"), (2, "Manha - 10:00"), (3, "Tarde - 14:00"), (4, "Tarde - 16:00"),
                 (5, "Noite - 19:00")],
    "class_group": [(1, "Nat-Infantil-M", 15, 1, 1), (2, "Fut-Sub15-T", 22, 4, 2), (3, "Vol-Adulto-N", 14, 5, 3),
                    (4, "Bas-Iniciante-M", 20, 2, 4), (5, "Jud-Avancado-T", 10, 3, 5)],
    "enrollment": [{"student_id": 1, "class_id": 1}, {"student_id": 2, "class_id": 2}, {"student_id": 3, "class_id": 3},
                   {"student_id": 4, "class_id": 4}, {"student_id": 5, "class_id": 5}, {"student_id": 1, "class_id": 2},
                   {"student_id": 2, "class_id": 3}],
    "teaches": [(6, 1), (7, 2), (8, 3), (9, 4), (10, 5)],
    "plan": [(1, "Plano Basico Mensal", Decimal("100.00"), 1, "Acesso a 1 esporte"),
             (2, "Plano Trimestral", Decimal("270.00"), 3, "Acesso a 1 esporte com desconto"),
             (3, "Plano Semestral Multi", Decimal("500.00"), 4, "Acesso a 2 esportes"),
             (4, "Plano Anual Premium", Decimal("900.00"), 5, "Livre acesso"),
             (5, "Plano Mensal Premium", Decimal("150.00"), 1, "Livre acesso mensal")],
    "invoice": [(1, Decimal("100.00"), D("2023-10-10"), D("2023-10-09"), 1, "PIX"),
                (2, Decimal("100.00"), D("2023-11-10"), None, 2, "Boleto"),
                (3, Decimal("270.00"), D("2023-10-15"), D("2023-10-15"), 1, "Cartao de Credito"),
                (4, Decimal("150.00"), D("2023-09-10"), None, 3, "PIX"),
                (5, Decimal("900.00"), D("2023-01-10"), D("2023-01-05"), 1, "Cartao de Credito")],
    "time_slot": [(1, "07:00:00", "08:00:00"), (2, "08:00:00", "09:00:00"), (3, "10:00:00", "11:00:00"),
                  (4, "18:00:00", "19:00:00"), (5, "19:00:00", "20:00:00")],
    "schedule_slot": [{"weekday": 2, "slot_id": 1, "schedule_id": 1}, {"weekday": 3, "slot_id": 2, "schedule_id": 1},
                      {"weekday": 4, "slot_id": 3, "schedule_id": 2}, {"weekday": 5, "slot_id": 4, "schedule_id": 3},
                      {"weekday": 6, "slot_id": 5, "schedule_id": 4}],
    "session": [{"held_on": D("2025-05-01"), "was_held": True, "class_id": 1},
                {"held_on": D("2025-05-02"), "was_held": True, "class_id": 2},
                {"held_on": D("2025-05-03"), "was_held": False, "class_id": 3},
                {"held_on": D("2025-05-04"), "was_held": True, "class_id": 4},
                {"held_on": D("2025-05-05"), "was_held": True, "class_id": 5}],
    "attendance": [{"present": True}, {"present": False}, {"present": True}, {"present": True}, {"present": False}],
    "student_plan": [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)],
    "guardianship": [(1, 6), (2, 7), (3, 8), (4, 9), (5, 10)],
    "cancellation": [(1, "Professor nao compareceu"), (2, "Dedetizacao"), (3, "Reforma no CT"), (4, "Muita chuva"),
                     (5, "Feriado municipal")],
}
