"""The curve of scores where the labels of the learning rows are all but parted."""

import numpy as np

from sparkweir.llm.toxicity import Model


def test_the_curve_is_found_however_far_the_labels_are_apart():
    for far in (1, 3, 10, 100):
        surprise = np.concatenate([[0.0], np.linspace(3, 9, 20), np.linspace(14, 300, 200)]) * far
        label = np.repeat([0.0, 1.0], [21, 200])
        weight = np.concatenate([[12_000.0], np.full(20, 9.0), np.full(200, 1.4)])
        model = Model({})
        model.calibrate_score(surprise, label, weight)
        score = 1 / (1 + np.exp(-np.clip(model.offset + model.slope * np.log1p(surprise), -500, 500)))
        assert model.slope > 0 and (score[label == 1] >= 0.7).mean() > 0.95 and (score[label == 0] < 0.7).all()
