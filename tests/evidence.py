"""Queries without a SQL form, and the test that holds the work of each against something independent."""

TESTED = {
    "sample_reports": "test_estimators.test_samples_of_rows",
    "approximate_distinct": "test_estimators.test_approximate_counts",
    "gaussian_generative": "test_invariants.test_class_moments_and_scores",
    "tune_gaussian": "test_estimators.test_gaussian_errors_equal_numpy",
    "gaussian_nb": "test_estimators.test_sweep_counts_the_errors_of_its_predictions",  # its predictions have SQL
    "lda_classifier": "test_estimators.test_discriminant_equals_numpy",
    "logistic_regression_grid": "test_estimators.test_logistic_grid",
    "linear_svm_features": "test_estimators.test_linear_svm_is_at_its_optimum",
    "linear_svm_strength": "test_estimators.test_linear_svm_is_at_its_optimum",
    "linear_perceptron_curve": "test_estimators.test_linear_perceptron_equals_logistic_regression",
    "decision_tree": "test_invariants.test_best_setting_is_refitted",
    "random_forest": "test_estimators.test_forest_is_the_mean_of_its_trees",
    "extra_trees": "test_trees.test_equals_plain_trees",
    "gradient_boosting": "test_estimators.test_boosting_adds_up_its_trees",
    "elastic_net": "test_cluster_methods.test_path_is_optimal_and_equals_the_library",
    "kmeans_inertia": "test_goldens.test_kmeans_centres",
    "mixture_choice": "test_cluster_methods.test_mixtures_keep_the_likeliest_start",
    "mixture_of_classes": "test_invariants.test_mixture",
    "cluster_bisecting": "test_estimators.test_bisecting_cuts_are_nested",
    "cluster_minibatch": "test_cluster_methods.test_minibatch_kmeans",
    "cluster_spectral": "test_eigen.test_spectral_clusters_of_five_hundred_vectors",
    "cluster_profiles": "test_invariants.test_all_reports_teach_the_profile_clusters",
    "per_cluster_scores": "test_estimators.test_models_of_clusters",
    "ensemble_of_models": "test_estimators.test_models_of_clusters",
    "pca_components": "test_invariants.test_pca_matches_numpy",
    "pca_projection": "test_invariants.test_residuals_of_the_full_basis_vanish",
    "spectral_order": "test_invariants.test_spectral_order_equals_dense",
    "t_test_p_values": "test_goldens.test_p_values",
    "chi_square_p_value": "test_goldens.test_p_values",
    "approximate_neighbours": "test_approximate.test_recall_on_twenty_thousand_vectors",
    "approximate_votes": "test_approximate.test_recall_on_twenty_thousand_vectors",  # the votes of the exact form have SQL
}
